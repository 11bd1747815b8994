"""SentencePiece encoding and decoding by vectorised merge rounds.

The merges of a byte-pair model are done for many words at once on flat numpy arrays: every round
finds for each word the smallest rank among its neighbouring pairs, merges all its leftmost
occurrences at the same time, and takes words without a further pair out. The library only reads the
model file; encoding and decoding are done here. The model's pieces (a bounded vocabulary) are sent
to the executors; texts are never.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SPACE = "▁"
NONE = np.int64(1) << 40
CACHE_WORDS = 200_000
ROUND_WORDS = 20_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    """Pieces, the rank of every pair of symbols that may merge, and bytes for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        n = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(n)]
        self.end, self.unknown = reader.eos_id(), reader.unk_id()
        scores = np.array([reader.get_score(i) for i in range(n)])
        special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) for i in range(n)]
        own = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        # Words are cut before a space that follows another character, and around line ends; this
        # is safe as long as no piece reaches over such a cut.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or (len(p) > 1 and "\n" in p) for p in own):
            raise ValueError("pieces that reach over a word's end are not supported")
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if reader.is_byte(i)}
        self.symbols = dict(own)
        for p in own:
            for c in p:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols) - len(own))
        self.width = len(self.pieces) + len(self.symbols) - len(own)
        rank_of = np.unique(-scores, return_inverse=True)[1]
        pairs, danger = {}, np.zeros(self.width, dtype=bool)
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
                    for part in (a, b):
                        # Merging `part` opens a pair that goes before the rest of its round.
                        danger[part] |= part < n and len(p) > 1 and rank_of[i] <= rank_of[part]
        self.danger, self.rank_of = danger, rank_of.astype(np.int64)
        self._hash(pairs)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if reader.is_byte(i) else b"" if reader.is_control(i) else " ⁇ ".encode() if reader.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def _hash(self, pairs: dict[int, int]) -> None:
        """Open addressing table of the pairs, read with whole-array probes."""
        size = 1 << (2 * len(pairs) + 1).bit_length()
        self.mask, self.keys, self.merged, self.probes = size - 1, np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32), 1
        for key, piece in pairs.items():
            at, tries = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0:
                at, tries = (at + 1) & self.mask, tries + 1
            self.keys[at], self.merged[at], self.probes = key, piece, max(self.probes, tries)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = left.astype(np.int64) * self.width + right
        out, at = np.full(len(keys), -1, dtype=np.int64), self._slot(keys)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[open_]
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.merged[at[hit]]
            go = ~hit & (there >= 0)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word (its spaces already written as the space symbol), all words together."""
        chars = np.array([ord(c) for w in words for c in w], dtype=np.int64)
        different, place = np.unique(chars, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), -1 - c) for c in different.tolist()], dtype=np.int64)
        symbol = known[place] if len(chars) else chars
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbol, done_word = [], []
        while len(symbol):
            made = np.full(len(symbol), -1, dtype=np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            made[inside] = self.merges(symbol[inside], symbol[inside + 1])
            rank = np.where(made >= 0, self.rank_of[np.maximum(made, 0)], NONE)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, begins)
            each = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(word))))
            best = least[each]
            finished = best == NONE
            if finished.any():
                done_symbol.append(symbol[finished])
                done_word.append(word[finished])
            pick = (rank == best) & ~finished
            at = np.flatnonzero(pick)
            if not len(at):
                break
            # Of pairs that overlap in a chain every other one merges, from the left.
            heads = np.concatenate([[True], np.diff(at) != 1])
            at = at[(at - at[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))]) % 2 == 0]
            leftmost = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            group = np.cumsum(leftmost) - 1
            risky = np.bincount(group, weights=self.danger[made[at]]) > 0
            at = at[leftmost | ~risky[group]]
            symbol[at] = made[at]
            keep = ~finished
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol = np.concatenate(done_symbol) if done_symbol else np.zeros(0, dtype=np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        symbol, edges = symbol[order], np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        plain = ((symbol >= 0) & (symbol < len(self.pieces))).all()
        flat = symbol.tolist()
        if plain:
            return [tuple(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        outside = {i: c for c, i in self.symbols.items() if i >= len(self.pieces)}
        return [tuple(chain.from_iterable((s,) if 0 <= s < len(self.pieces) else self._bytes(outside[s] if s >= 0 else chr(-1 - s)) for s in flat[a:b])) for a, b in zip(edges[:-1], edges[1:])]

    def _bytes(self, char: str):
        raw = char.encode()
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown]

    def decode(self, ids) -> bytes:
        """Text of the ids, as UTF-8: the space put before the first word goes, ends are nothing."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw


WORD = re.compile(" +[^ \n]*|\n|[^ \n]+")


class Encoder:
    """Words of texts to ids, with the words met so far kept up to a bound."""

    def __init__(self, model: Model, written: bool = False):
        """``written`` also keeps the ids as decimal digits."""
        self.model, self.written, self.ids, self.digits = model, written, {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        fresh = list({w for words in texts for w in words if w not in self.ids})
        if len(self.ids) + len(fresh) > CACHE_WORDS:
            self.ids, self.digits = {}, {}
            fresh = list({w for words in texts for w in words})
        for a in range(0, len(fresh), ROUND_WORDS):
            part = fresh[a : a + ROUND_WORDS]
            for w, ids in zip(part, self.model.encode_words([w.replace(" ", SPACE) for w in part])):
                self.ids[w] = ids
                if self.written:
                    self.digits[w] = " ".join(map(str, ids)).encode()


def words_of(text: str) -> list[str]:
    """Cuts of a text with the space that stands before it; an empty text has none."""
    return WORD.findall(" " + text.replace(SPACE, " ")) if text else []


def text_groups(batches, limit: int = 2 << 20):
    """(rows, texts) of consecutive rows with about ``limit`` characters together."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def encoded(model, with_ids: bool):
    """Per document: number of ids, the ids or their digest, and the digest of the decoded text."""

    def run(batches):
        encoder = Encoder(model.value, not with_ids)
        for rows, texts in text_groups(batches):
            cuts = [words_of(t) for t in texts]
            encoder.learn(cuts)
            end = str(model.value.end).encode()
            counts, ids_out, ids_digest, text_digest = [], [], [], []
            for words in cuts:
                ids = [*chain.from_iterable(map(encoder.ids.__getitem__, words)), model.value.end]
                counts.append(len(ids))
                if with_ids:
                    ids_out.append(ids)
                    continue
                ids_digest.append(hashlib.sha256(b" ".join([*map(encoder.digits.__getitem__, words), end])).hexdigest())
                text_digest.append(hashlib.sha256(model.value.decode(ids)).hexdigest())
            columns = [rows.column(0), pa.array(counts, pa.int64())]
            if with_ids:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_out, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _broadcast_model(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Model(path))  # as large as its vocabulary


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text, then the end id."""
    docs = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return docs.mapInArrow(encoded(_broadcast_model(documents, path), True), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text."""
    model = _broadcast_model(encoded_docs, path)

    def run(batches):
        for batch in batches:
            texts = [model.value.decode(ids or []).decode("utf-8", errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select(encoded_docs["doc_id"].cast("bigint").alias("doc_id"), encoded_docs["ids"].alias("ids")).mapInArrow(run, "doc_id long, text string")


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    A null text counts as empty, which has the end id alone. Every row is handled by itself: repeated
    rows, null doc_ids and further columns change nothing; an empty table gives no rows.
    """
    docs = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return docs.mapInArrow(encoded(_broadcast_model(documents, path), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(documents: DataFrame, path: str) -> DataFrame:
    """The documents with two more columns: ``ids``, the pieces of the whole text and the end id, and
    ``decoded``, the text that these ids stand for. Columns of these names are replaced."""
    model = _broadcast_model(documents, path)
    docs = documents.select(*[c for c in documents.columns if c not in ("ids", "decoded")])
    names = docs.columns

    def run(batches):
        encoder = Encoder(model.value)
        for rows, texts in text_groups(batches):
            cuts = [words_of(t) for t in texts]
            encoder.learn(cuts)
            ids = [[*chain.from_iterable(map(encoder.ids.__getitem__, words)), model.value.end] for words in cuts]
            decoded = [model.value.decode(own).decode("utf-8", errors="replace") for own in ids]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
