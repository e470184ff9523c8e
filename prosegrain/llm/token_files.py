"""Token-ID files: each document's ids compressed on their own with one shared zstandard dictionary.

A file holds, one after the other: the magic bytes, a length and a JSON header (width of an id, SHA-256 of the dictionary, number of
documents), the index (doc_id, whether there is one, place, compressed length, ids of each document) and the frames. A reader
seeks to one document's frame; it refuses a dictionary whose hash is not the header's. The dictionary lies beside the files,
and a manifest, written by Spark when all files are there, names those that count: files of attempts that died do not.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrain.llm.common import Batches, bound_batches, column, fresh_path, located, put, taken

MAGIC = b"PGIDS1\0\0"
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("at", "<u8"), ("length", "<u4"), ("ids", "<u4")])
#: Compressed bytes and documents after which a task begins another file.
FILE_BYTES, FILE_DOCS = 32 << 20, 100_000
#: The dictionary is trained on slices of so many characters at hashed places of so many documents, chosen by hash; this only moves the compression rate.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY = 1000, 2000, 32 << 10
#: Words whose ids a worker keeps; beyond, only those of the batch at hand stay.
CACHE = 700_000
#: Words whose ids are put together at once.
WORDS_AT_ONCE = 1 << 18
#: Tasks that read files back, at most.
READERS = 5000
#: Stands for the number of ids of a word that cannot be cut out of its text.
ODD = -1


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """ids of whole texts exactly as the tokenizers library gives them, by words the library has seen before.

    A space before a printable character starts a pre-token of byte-level BPE whatever stands before it, and a line end between
    two such characters is one by itself; so the library's ids of the words between are the ids of the text. New words go to
    the library many at once, joined by what parts them in a text. A text goes to the library whole if it might hold an
    added token, or has other white space around a cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.cuts = spec["model"]["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        self.added = [x["content"] for x in spec["added_tokens"]]
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.line_end = self.tok.encode("\n", add_special_tokens=False).ids
        #: words as they follow a space or, with it, a line end; where their ids begin in flat, and how many there are.
        self.words, self.flat = pa.array([], pa.large_string()), np.zeros(0, dtype="<u4")
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.tails: dict[str, np.ndarray] = {}

    def ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    #: Printable ASCII or letters at both ends, so that a cut parts no run of white space.
    SAFE = "(?s)^\n?[!-~\u00c0-\u024f](.*[!-~\u00c0-\u024f])?$"

    #: Punctuation after a letter is a pre-token of its own (an apostrophe may not be), so it can be cut off.
    TAIL = '(?s)^(?P<base>.*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?P<tail>[.,!?;:#$%&*|)"]+)$'

    def keep(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        own = np.maximum(sizes, 0)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(own) - own])
        self.words, self.flat, self.size = pa.concat_arrays([self.words, words]), np.concatenate([self.flat, flat]), np.concatenate([self.size, sizes])

    def learn(self, words: pa.Array) -> None:
        """words: different and new."""
        safe = pc.match_substring_regex(words, self.SAFE)
        breaks = pc.starts_with(words, "\n")
        for between, chosen in ((" ", pc.and_(safe, pc.invert(breaks))), ("\n", pc.and_(safe, breaks))):
            part = words.filter(chosen)
            plain = (part if between == " " else pc.utf8_slice_codeunits(part, 1)).to_pylist()
            flat, sizes = [], []
            for k in range(0, len(plain), 500):
                ids = self.ids([between + between.join(plain[k : k + 500])])[0]
                starts = np.flatnonzero(self.spaced[ids] if between == " " else ids == self.line_end[0])
                assert len(starts) == len(plain[k : k + 500])
                flat.append(ids)
                sizes.append(np.diff(starts, append=len(ids)))
            if plain:
                self.keep(part, np.concatenate(flat), np.concatenate(sizes))
        rest = words.filter(pc.invert(safe))
        self.keep(rest, np.zeros(0, dtype="<u4"), np.full(len(rest), ODD))

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places of different words among those known, all of which are known afterwards."""
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return np.asarray(at)
        new = words.filter(pc.is_null(at))
        if len(self.words) + len(new) > CACHE:  # what this batch has is worth keeping
            old = np.asarray(at.drop_null())
            held, flat, size = self.words.take(pa.array(old)), gather(self.flat, self.begin[old], np.maximum(self.size[old], 0)), self.size[old]
            self.words, self.flat, self.begin, self.size = self.words[:0], self.flat[:0], self.begin[:0], self.size[:0]
            self.keep(held, flat, size)
        cut = pc.extract_regex(new, self.TAIL)
        whole = pc.is_null(cut)
        bases = pc.if_else(whole, new, pc.struct_field(cut, "base")).unique()
        self.learn(bases.filter(pc.is_null(pc.index_in(bases, value_set=self.words))))
        cut, new = cut.drop_null(), new.filter(pc.invert(whole))
        if len(new):
            tails = pc.struct_field(cut, "tail").dictionary_encode()
            names = tails.dictionary.to_pylist()
            fresh = [t for t in names if t not in self.tails]
            self.tails.update(zip(fresh, self.ids(fresh)))
            ends = [self.tails[t] for t in names]
            lengths = np.array([len(x) for x in ends])
            base, tail = np.asarray(pc.index_in(pc.struct_field(cut, "base"), value_set=self.words)), np.asarray(tails.indices)
            odd = self.size[base] < 0
            sizes = np.stack([np.maximum(self.size[base], 0), np.where(odd, 0, lengths[tail])], axis=1)
            starts = np.stack([self.begin[base], len(self.flat) + (np.cumsum(lengths) - lengths)[tail]], axis=1)
            flat = gather(np.concatenate([self.flat, *ends]), starts.ravel(), sizes.ravel())
            self.keep(new, flat, np.where(odd, ODD, sizes.sum(axis=1)))
        return np.asarray(pc.index_in(words, value_set=self.words))

    def encode(self, docs: pa.Array) -> list[np.ndarray]:
        """ids of each text; a null is empty."""
        docs = pc.fill_null(docs.cast(pa.large_string()), "")
        if not len(docs) or not self.cuts or len(self.line_end) != 1:
            return self.ids(docs.to_pylist())
        # every word after one space, and a line end before those that begin a line; what stands before the first space is empty
        words = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", docs, "\n"))), "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        begin = np.asarray(words.offsets).astype(np.int64)
        at = self.look_up(coded.dictionary)[np.asarray(coded.indices)]
        odd = self.size[at] < 0
        odd[begin[:-1]] = False
        whole = np.logical_or.reduceat(odd, begin[:-1])
        for a in self.added:
            whole |= np.asarray(pc.match_substring(docs, a))
        out: list[np.ndarray] = []
        first = 0
        while first < len(docs):
            last = max(first + 1, int(np.searchsorted(begin, begin[first] + WORDS_AT_ONCE, side="right")) - 1)
            own = at[begin[first] : begin[last]]
            sizes = np.maximum(self.size[own], 0)
            ids = gather(self.flat, self.begin[own], sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])[begin[first : last + 1] - begin[first]]
            # the first line has no line end before it
            out += [ids[i + 1 : j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            first = last
        again = np.flatnonzero(whole).tolist()
        for k, x in zip(again, self.ids([docs[k].as_py() for k in again])):
            out[k] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary trained on serialized id arrays; empty if there is nothing to train on."""
    # a share of the hashes that holds a few times the sample, so that tasks send the driver little whatever the corpus
    share = int(min(1.0, 4 * SAMPLE_DOCS / max(1, docs.count())) * (1 << 30))
    text = F.coalesce("text", F.lit(""))
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS))
    hashed = docs.select(F.substring(text, place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), F.xxhash64("doc_id").alias("h"))
    first = hashed.where(F.pmod("h", F.lit(1 << 30)) <= share).orderBy("h").limit(SAMPLE_DOCS)
    enc = encoder(tokenizer)
    samples = [x for x in (serialize(i, end_id, enc.width) for i in enc.encode(pa.array([r["text"] for r in first.collect()], pa.string()))) if len(x) > 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few or too like each other
        return b"".join(samples)[-DICTIONARY:]


def serialize(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every whole text of docs (doc_id, text) under uri, in ascending doc_id order, null first.

    One shuffle deals the texts out by ranges of doc_id; a task encodes and writes its range, file by file, and holds one file at
    most. A null text is empty and has the end id alone; rows of one doc_id follow each other by their text's hash.
    """
    bound_batches(docs.sparkSession, rows=5000)
    dictionary = train_dictionary(docs, tokenizer, end_id)
    put(f"{uri}/dictionary", [dictionary])

    def write(batches: Batches) -> Batches:
        enc, part, k = encoder(tokenizer), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3, dict_data=as_dictionary(dictionary), write_content_size=True, write_checksum=False)
        index, frames, held = [], [], 0

        def flush() -> pa.RecordBatch:
            head = json.dumps({"width": enc.width, "dictionary": hashlib.sha256(dictionary).hexdigest(), "docs": len(index)}).encode()
            name = f"part-{part:06d}-{k:05d}.ids"
            put(f"{uri}/{name}", [MAGIC, len(head).to_bytes(4, "little"), head, np.array(index, dtype=INDEX).tobytes(), *frames])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (k, pa.int64()), (name, pa.string()), (len(index), pa.int64()), (sum(x[4] for x in index), pa.int64()))], names=["part", "k", "name", "docs", "ids"])

        for batch in batches:
            for doc_id, ids in zip(column(batch, "doc_id"), enc.encode(batch.column(1))):
                frames.append(frame := press.compress(serialize(ids, end_id, enc.width)))
                index.append((doc_id or 0, doc_id is not None, held, len(frame), len(ids) + 1))
                held += len(frame)
                if held >= FILE_BYTES or len(index) >= FILE_DOCS:
                    yield flush()
                    index, frames, held, k = [], [], 0, k + 1
        if index:
            yield flush()

    # the hash parts rows of one doc_id, or of none, into ranges of their own
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(write, "part bigint, k bigint, name string, docs bigint, ids bigint").write.parquet(f"{uri}/manifest")


class TokenFile:
    """One file, read by its index."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = located(uri)
        self.file = store.open_input_file(path)
        assert self.file.read(len(MAGIC)) == MAGIC, f"{uri} is no token file"
        head = json.loads(self.file.read(int.from_bytes(self.file.read(4), "little")))
        if head["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.kind = f"<u{head['width']}"
        self.index = np.frombuffer(self.file.read(head["docs"] * INDEX.itemsize), dtype=INDEX)
        self.body = self.file.tell()
        self.press = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """ids of the k-th document of this file, without touching the others."""
        self.file.seek(self.body + int(self.index[k]["at"]))
        raw = self.press.decompress(self.file.read(int(self.index[k]["length"])))
        ids = np.frombuffer(raw, dtype=self.kind).astype("<u4")
        assert len(ids) == self.index[k]["ids"]
        return ids


def read_dictionary(uri: str) -> bytes:
    return taken(f"{uri}/dictionary")


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under uri, one row each."""
    bound_batches(spark)
    files = spark.read.parquet(f"{uri}/manifest")
    # starts from two short sums: over the files of a part, and over the parts
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("more", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(parts, "part").select("name", (F.col("base") + F.col("more")).alias("start"))

    def read(batches: Batches) -> Batches:
        dictionary = read_dictionary(uri)
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(f"{uri}/{row['name']}", dictionary)
                n = f.index["ids"].astype(np.int64)
                crc = [zlib.crc32(f.ids(k).tobytes()) for k in range(len(n))]
                doc = pa.array(f.index["doc_id"].astype(np.int64), mask=f.index["known"] == 0)
                yield pa.RecordBatch.from_arrays([doc, pa.array(row["start"] + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a stated number of parts: names are few bytes, so by size all files would fall to one task
    return files.repartition(max(1, min(READERS, files.count())), "name").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to a new folder in the shared one and return what reading it back gives: a row for each row of docs.

    An empty table gives an empty result. Columns of docs but doc_id and text are not read.
    """
    uri = fresh_path(docs.sparkSession, "token-ids")
    write_token_files(docs, uri, tokenizer, end_id)
    return read_token_files(docs.sparkSession, uri)
