"""Url expressions. A url that does not parse gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidings.functions.text import let

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Fixed value: characters that stand percent-encoded in a path.
OUTSIDE_PATH = r"[\x00-\x20\x22<>^`{}\x7f]|[^\x00-\x7f]"

# Query parameters that only track the visitor, matched on the lower-cased name.
TRACKING_PARAMETERS = r"^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|ref_url|igshid|spm|si|cmpid|icid)$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL), F.lit(False))


def host(url: Column) -> Column:
    return F.when(is_url(url), F.lower(_part(url, 2)))


def scheme(url: Column) -> Column:
    return F.when(is_url(url), F.lower(_part(url, 1)))


def path(url: Column) -> Column:
    raw = _part(url, 4)
    return F.when(is_url(url), normal_path(F.when(raw == "", F.lit("/")).otherwise(raw)))


def normal_path(raw: Column) -> Column:
    """A path without ``.`` and ``..`` steps, with blanks and other characters that a path cannot hold
    percent-encoded, as browsers write it."""

    def encoded(text: Column) -> Column:
        hexed = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
        return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(OUTSIDE_PATH), hexed(c)).otherwise(c)), "")

    def stepped(text: Column) -> Column:
        steps = F.slice(F.split(text, "/"), 2, F.greatest(F.size(F.split(text, "/")), F.lit(1)))
        numbered = F.transform(steps, lambda s, i: F.struct(F.replace(F.lower(s), F.lit("%2e"), F.lit(".")).alias("dots"), s.alias("s"), (i == F.size(steps) - 1).alias("last")))

        def walk(held: Column, step: Column) -> Column:
            up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(held)
            here = F.when(step["dots"] == "..", up).otherwise(held)
            # A path that ends in a step ends in a folder.
            folder = F.when(step["last"], F.array_append(here, F.lit(""))).otherwise(here)
            return F.when(step["dots"].isin(".", ".."), folder).otherwise(F.array_append(held, step["s"]))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), walk), "/"))

    clean = let(raw, lambda text: F.when(text.rlike(OUTSIDE_PATH), encoded(text)).otherwise(text))
    return let(clean, lambda text: F.when(text.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), stepped(text)).otherwise(text))


def query(url: Column) -> Column:
    return F.when(is_url(url), _part(url, 5))


def authority(url: Column) -> Column:
    """Host with its port, the port left out when it is the scheme's own."""
    port, kind = _part(url, 3), scheme(url)
    own = (port == "") | ((kind == "http") & (port == "80")) | ((kind == "https") & (port == "443"))
    return F.concat(host(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path_and_query(url: Column) -> Column:
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def _decoded(piece: Column) -> Column:
    return F.coalesce(F.try_url_decode(piece), piece)


def canonical_url(url: Column) -> Column:
    """One form for all copies of a link: no fragment, no tracking parameters, sorted parameters,
    lower-case host, no trailing slash."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("name"),
            _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("value"),
        ),
    )
    kept = F.filter(named, lambda p: ~F.lower(p["name"]).rlike(TRACKING_PARAMETERS))
    numbered = F.transform(kept, lambda p, i: F.struct(p["name"].alias("name"), i.alias("at"), p["value"].alias("value")))
    text = F.array_join(
        F.transform(F.array_sort(numbered), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )
    trimmed = let(path(url), lambda p: F.when(F.char_length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p))
    return F.concat(origin(url), trimmed, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))


def host_key(url: Column) -> Column:
    """Host without ``www.``, null for text that is not a url."""
    return F.regexp_replace(host(url), r"^www\.", "")


def host_label(url: Column) -> Column:
    return F.coalesce(host_key(url), F.lit("Unknown source"))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://"), url)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against the page it stands on."""
    href = F.trim(href)
    # A relative link: its path, put behind the base's folder, then its query; the fragment goes.
    plain = F.split(href, "#", 2)[0]
    own, asked = F.split(plain, r"\?", 2)[0], F.try_element_at(F.split(plain, r"\?", 2), F.lit(2))
    behind = F.when(asked.isNotNull(), F.concat(F.lit("?"), asked)).otherwise(F.lit(""))
    on_page = F.coalesce(F.nullif(_part(base, 4), F.lit("")), F.lit("/"))
    target = normal_path(F.when(own == "", on_page).when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_replace(on_page, "[^/]*$", ""), own)))
    return (
        F.when(is_url(href), F.concat(origin(href), path(href), F.when(query(href) != "", F.concat(F.lit("?"), query(href))).otherwise(F.lit(""))))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .otherwise(F.concat(origin(base), target, behind))
    )


def is_private_ipv4(address: Column) -> Column:
    """Private, loopback, link-local, carrier, multicast and reserved IPv4 ranges."""
    octets = F.split(address, r"\.")
    a, b = octets[0].cast("int"), octets[1].cast("int")
    return (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168))
        | ((a == 100) & b.between(64, 127))
    )


def is_public_url(url: Column) -> Column:
    """Literal checks of the fetch guard: http(s), not local, not a private address."""
    name = F.regexp_replace(host(url), r"^\[|\]$", "")
    v4 = r"^(\d{1,3}\.){3}\d{1,3}$"
    mapped = F.regexp_extract(name, r"^::ffff:((?:\d+\.){3}\d+)$", 1)
    v6_private = name.isin("::", "::1") | name.rlike("^(fe[89ab]|f[cd])")
    return F.coalesce(
        scheme(url).isin("http", "https")
        & ~((name == "localhost") | F.endswith(name, F.lit(".localhost")))
        & F.when(name.rlike(v4), ~is_private_ipv4(name))
        .when(mapped != "", ~is_private_ipv4(F.when(mapped != "", mapped).otherwise(F.lit("0.0.0.0"))))
        .when(F.contains(name, F.lit(":")), ~v6_private)
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def path_date(url: Column, lastmod: Column) -> Column:
    """Publication date held in the path. A month-only path keeps a lastmod of that month."""
    def number(part: Column, digits: int, low: int, high: int) -> Column:
        value = part.try_cast("int")
        return (F.char_length(part) == digits) & part.rlike("^[0-9]+$") & value.between(low, high)

    def dated(steps: Column) -> Column:
        """Of the steps the first that is a year and is followed by a month."""
        at = F.transform(steps, lambda s, i: F.struct(s.alias("y"), F.get(steps, i + 1).alias("m"), F.get(steps, i + 2).alias("d")))
        first = F.get(F.filter(at, lambda x: F.coalesce(number(x["y"], 4, 2000, 2099) & number(x["m"], 2, 1, 12), F.lit(False))), F.lit(0))
        return let(
            first,
            lambda x: F.when(F.coalesce(number(x["d"], 2, 1, 31), F.lit(False)), F.concat_ws("-", x["y"], x["m"], x["d"]))
            .when(F.substring(lastmod, 1, 7) == F.concat_ws("-", x["y"], x["m"]), lastmod)
            .when(x["y"].isNotNull(), F.concat_ws("-", x["y"], x["m"], F.lit("01"))),
        )

    return let(F.split(path(url), "/"), dated)


def rule_pattern(rule: Column) -> Column:
    """Regular expression of a robots rule: ``*`` is a wildcard, a final ``$`` anchors the end."""
    anchored = F.endswith(rule, F.lit("$"))
    body = F.when(anchored, F.substring(rule, F.lit(1), F.char_length(rule) - 1)).otherwise(rule)
    parts = F.transform(F.split(body, r"\*"), lambda part: F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))
