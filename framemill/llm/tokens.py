"""Token-id output as length-delimited binary records, with an offset index for shuffled reads.

A record: length of the payload (8 bytes, little-endian), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4), and a line feed. The payload: doc_id (8, signed), bytes per id (1), the ids. The mask
rotates the CRC-32 right by 15 bits and adds a constant, so that checksums of data that holds checksums stay useful.

Spark writes the files (one per range of doc_ids, sized by bytes of text) through its own committed text sink, so any
file system and a lost executor are fine; they are read back with the binaryFile source. The index is a table of
its own: file, offset, length, doc_id, n_tokens, and the token position in its file.

Texts are split where no token can span: before a space between two non-spaces and, in texts without runs of white
space, around line feeds, by Arrow. A batch's pieces become a dictionary, so that Python sees each distinct one once; new
ones are encoded by the tokenizers library, many in one call, and kept in a bounded memo per worker. The ids of all pieces are
gathered by their numbers in the dictionary. A text with an added token of the tokenizer (its own id, as in the plain call) is
encoded whole.

Defined cases: a null text is empty and has the end id alone; repeated doc_ids get adjacent records; a null doc_id
sorts first and is kept as null; an empty table writes nothing and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: The memo holds up to MEMO pieces of up to MEMO_KEY characters; CALL new ones are encoded in one call of the library.
FILE_BYTES, MEMO, MEMO_KEY, CALL = 16 << 20, 600_000, 64, 1024
#: Bytes of texts whose pieces share a dictionary.
RUN_BYTES = 4 << 20
NO_ID = -(1 << 63)
_MASK = 0xA282EAD8  # fixed value of the record format

HEAD, SPACE = "\x1c", "\u0120"  # marks the first piece of a text; a space as byte-level vocabularies write it
_RUNS = r"[\s\v\x85\p{Z}]{2}|[\x1c-\x1f]"  # for Arrow, whose \s is ASCII's without the vertical tab
_ALONE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, tuple] = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data: memoryview):
    """(offset, payload) of each record; raises on a broken one."""
    at = 0
    while at < len(data):
        n, c = struct.unpack_from("<QI", data, at)
        payload = data[at + 12 : at + 12 + n]
        if masked(bytes(data[at : at + 8])) != c or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0] or data[at + 16 + n] != 10:
            raise ValueError(f"broken record at byte {at}")
        yield at, payload
        at += n + 17


class Encoder:
    """Ids of texts as bytes of a fixed width, through a bounded memo of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that start with a space
        self.opens[[i for token, i in vocab.items() if token[0:1] == SPACE]] = True

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word, encoded as one text: no token spans two, and only a word's first one starts with a space."""
        e = self.tokenizer.encode_batch_fast(["".join([" " + w for w in words])], add_special_tokens=False)[0]
        ids = np.array(e.ids, dtype=self.kind)
        raw, ends = ids.tobytes(), (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:])]

    @staticmethod
    def keys(texts: pa.Array, runs: bool) -> pa.Array:
        """A list of pieces for each text, in order: a bare key stands for a space and itself, one that starts with a line
        feed for itself, and one that starts with HEAD for what follows. runs: the texts have runs of white space."""
        if runs:
            return pa.array([_ALONE.split(HEAD + t) for t in texts.to_pylist()], pa.list_(pa.large_string()))
        return pc.split_pattern(pc.utf8_replace_slice(pc.replace_substring(texts, "\n", " \n"), 0, 0, HEAD), " ")

    def fill(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of keys that the memo lacks."""
        # a text's head may not follow another piece, white space at an end may not precede one
        alone = {k: k[1:] if k[0:1] == HEAD else k if k[0:1] == "\n" else " " + k for k in keys if not k or k[0] in HEAD + "\n" or " " in k or k[-1].isspace()}
        got = dict(zip(alone, self.raw([*alone.values()])))
        rest = [k for k in keys if k not in got]
        for lo in range(0, len(rest), CALL):
            part = rest[lo : lo + CALL]
            got.update(zip(part, self.apart(part), strict=True))
        return got

    def ids(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys."""
        memo = self.memo
        found = list(map(memo.get, keys))
        new = [k for k, v in zip(keys, found) if v is None]
        cut = {k: w for k in new if (w := k.rstrip(string.punctuation)) != k and w[-1:].isalnum()}  # tokens end between a word and its marks
        parts = {*cut.values(), *[HEAD + k[len(w) :] for k, w in cut.items()], *[k for k in new if k not in cut]}
        got = {k: v for k in parts if (v := memo.get(k)) is not None}
        fresh = self.fill([k for k in parts if k not in got])
        got.update(fresh)
        whole = [(k, got[w] + got[HEAD + k[len(w) :]]) for k, w in cut.items()]
        got.update(whole)
        memo.update([(k, v) for k, v in [*fresh.items(), *whole][: max(0, MEMO - len(memo))] if len(k) <= MEMO_KEY])
        return [got[k] if v is None else v for k, v in zip(keys, found)]

    def joined(self, lists: pa.Array) -> list[bytes]:
        """Ids of the texts whose keys are given."""
        coded = lists.flatten().dictionary_encode()
        ids, key, width = self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(), self.kind.itemsize
        flat, size = np.frombuffer(b"".join(ids), dtype=self.kind), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
        n = size[key]
        end = np.cumsum(n)
        raw = flat[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[key] - (end - n), n)].tobytes()
        cuts = (np.concatenate(([0], end))[lists.offsets.to_numpy()] * width).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        added = np.zeros(len(texts), dtype=bool)
        for t in self.added:
            added |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for kind in (False, True):
            rows = np.flatnonzero(~added & (runs == kind))
            if len(rows):
                for i, ids in zip(rows.tolist(), self.joined(self.keys(texts.take(pa.array(rows)), kind))):
                    out[i] = ids
        for i in np.flatnonzero(added).tolist():
            out[i] = self.raw([texts[i].as_py()])[0]
        return out


def text_runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of up to size bytes; a longer text is a run of its own."""
    end = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] + size, side="right")) - 1)
        yield lo, hi - lo
        lo = hi


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_records(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Files of framed records below path, ascending in doc_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        encoder = _encoder(_tokenizer_path(tokenizer))
        end = np.array([END_ID], dtype=encoder.kind).tobytes()
        width = bytes([encoder.kind.itemsize])
        for b in batches:
            for lo, n in text_runs(b.column(1)):
                ids, texts = b.column(0).slice(lo, n).to_pylist(), b.column(1).slice(lo, n)
                out = [frame(struct.pack("<q", NO_ID if i is None else i) + width + e + end)[:-1] for i, e in zip(ids, encoder.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    ordered.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, doc_id, n_tokens, in_file (tokens before it in its file) and ids_crc32 of every record."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), memoryview(b.column(1)[i].as_buffer())
                cols, before = [[] for _ in range(7)], 0
                for at, p in unframe(data):
                    doc, width = struct.unpack_from("<qB", p)
                    ids = np.frombuffer(p, dtype=f"<u{width}", offset=9).astype("<u4")
                    for c, v in zip(cols, (name, at, len(p) + 17, None if doc == NO_ID else doc, len(ids), before, zlib.crc32(ids.tobytes()))):
                        c.append(v)
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["file", "offset", "length", "doc_id", "n_tokens", "in_file", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, doc_id long, n_tokens long, in_file long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: ids of all records before. Files hold ascending, disjoint ranges of doc_ids; a row per file is summed."""
    files = index.groupBy(F.col("file").alias("f")).agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"))
    w = Window.orderBy(F.col("least").asc_nulls_first(), "f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("f", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return index.join(files, F.col("file") == F.col("f")).withColumn("start", F.col("before") + F.col("in_file")).drop("f", "before")


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_records(table(spark, sf_dir, "documents"), f"{scratch.base}/records")
    index = scratch.save(read_index(spark, f"{scratch.base}/records"), "index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")
