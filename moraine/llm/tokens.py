"""Token ids in range-coded files.

Texts are encoded by a public tokenizer, an end id is appended to each document,
and the ids are written in ascending document order.  One file per range of
documents holds groups of blocks (see `rangecoder`): a group has the frequencies of
its ids, and every block of at most `BLOCK` ids is coded from fresh models and has
its own checksum, so a damaged block is noticed and costs no other group.

Encoding remembers words: a tokenizer that drops white space and never joins
across it gives a text the ids of its words in turn, so the library encodes a word
that a worker knows no second time.  `by_word` reads from the tokenizer's own definition
whether it is of that kind; texts are encoded whole by any other.

Layout of a file: groups, each `MAGIC`, five little-endian uint32 (documents, ids,
blocks, length of the frequencies, length of the code), the documents' ids (int64;
null as the least value, with a flag byte each) and numbers of ids (uint32), the
distinct ids (uint16) with their frequencies (uint32) in zlib's format, each
block's ids, checksum and length (uint32 each), and the blocks' code.

Defined results: a null or empty text has the end id only; a null id sorts first;
rows with equal ids stand side by side, in the order of a hash of their texts; a
tokenizer whose ids don't fit into 16 bits is refused by a ValueError; other
columns are not read; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_folder, scratch, settled
from .hashing import parts
from .rangecoder import decode, encode
from .warc import _store

MAGIC = b"MRNT2\n"
#: Ids of a group at most, and of a block.
GROUP, BLOCK = 1 << 23, 4096
END = 1
#: Follows each word of a text of `JOINED` words that the library is given.
MARK, JOINED = "\x01", 256
#: Characters of all words that a worker knows at most, between batches.
MOST_CHARS = 16 << 20
#: Bytes of a task's texts, by the plan's own estimate, above which there are more tasks than shuffle partitions.
TASK_BYTES = 128 << 20
_WHITE = "\t\n\x0b\x0c\r "


def _flat(step: dict | None, within: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences opened."""
    if step is None:
        return []
    return [y for x in step[within] for y in _flat(x, within)] if step["type"] == "Sequence" else [step]


def by_word(definition: dict) -> bool:
    """Whether, by a tokenizer's definition, a text has the ids of its words in turn, words being split at ASCII white space.

    Its normalizers must work within words (NFC, lower case) or on white space only, its
    first pre-tokenizer must drop all white space, and no added token may hold any.
    """
    for step in _flat(definition.get("normalizer"), "normalizers"):
        if step["type"] not in ("NFC", "Lowercase") and not (step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "):
            return False
    first = next(iter(_flat(definition.get("pre_tokenizer"), "pretokenizers")), {"type": None})
    if first["type"] == "Split":
        pattern = first["pattern"].get("Regex", "")
        # What is kept are the matches, and no match may hold white space: neither by a literal, nor by a class.
        bare = regex.sub(r"\[\^[^]]*\\s[^]]*\]", "", pattern)
        if not (first["invert"] and first["behavior"] == "Removed" and pattern) or any(c in bare for c in (*_WHITE, ".", "[^", r"\s", r"\S", r"\W", r"\D", r"\P", r"\X", r"\x", r"\u", r"\p{Z", r"\p{C", "(?")):
            return False
        if any(regex.search(pattern, c) for c in _WHITE):
            return False
    elif first["type"] not in ("WhitespaceSplit", "BertPreTokenizer"):
        return False
    return not any(c in token["content"] for token in definition.get("added_tokens") or () for c in _WHITE) and definition.get("truncation") is None and definition.get("padding") is None


class Encoder:
    """Ids of texts, word by word where that is the same.

    The library is given many words at a time, each followed by `MARK`, where the
    tokenizer works on bytes: then the mark's only id can come from nothing but the
    mark, and words that hold it are encoded one by one.  Of more than `most_words`
    known words only those that were met in several batches stay, or none where these
    are too many as well, or where all words have more than `MOST_CHARS` characters.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            definition = json.load(source)
        self.by_word = by_word(definition)
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF:
            raise ValueError(f"{path}: files hold ids of 16 bits, and this tokenizer has larger ones")
        bytewise = definition["model"]["type"] == "BPE" and any(x["type"] == "ByteLevel" for x in _flat(definition.get("pre_tokenizer"), "pretokenizers"))
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids if self.by_word and bytewise else []
        self.mark = mark[0] if len(mark) == 1 else None
        self.most = most_words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.chars = 0
        self.arena = np.empty(0, np.uint16)
        self.starts, self.lengths, self.met = (np.zeros(1, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Forgets words, where there are too many, all but those met in several batches first."""
        often = self.met > 1
        often[0] = True
        if 2 * int(often.sum()) > self.most:
            self._forget()
            return
        lengths, at = self.lengths[often], np.flatnonzero(often)
        ends = np.cumsum(lengths)
        self.arena = self.arena[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(int(ends[-1]))]
        self.starts, self.lengths, self.met = ends - lengths, lengths, np.zeros(len(at), np.int64)
        place = np.cumsum(often) - 1
        self.known = {x: int(place[n]) for x, n in self.known.items() if often[n]}
        self.chars = sum(map(len, self.known))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and their numbers."""
        if self.mark is not None and not any(MARK in x for x in words):
            after = f" {MARK} "
            texts = [after.join([*words[a : a + JOINED], ""]) for a in range(0, len(words), JOINED)]
            # Few texts at a time: what the library returns takes many times the memory of its ids.
            ids = np.concatenate([np.array(x.ids, np.uint16) for a in range(0, len(texts), 32) for x in self.tokenizer.encode_batch_fast(texts[a : a + 32], add_special_tokens=False)])
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words):
                return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        listed = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, listed), np.int64, len(listed))
        return np.fromiter(chain.from_iterable(listed), np.uint16, int(lengths.sum())), lengths

    def _learn(self, words: list[str]) -> None:
        ids, lengths = self._ids(words)
        self.starts = np.concatenate([self.starts, len(self.arena) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.met = np.concatenate([self.met, np.zeros_like(lengths)])
        self.arena = np.concatenate([self.arena, ids])
        self.chars += sum(map(len, words))
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words))))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and their numbers; a null is empty."""
        texts = pc.fill_null(texts, "")
        return self._by_word(texts) if self.by_word else self._whole(texts.to_pylist())

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*x.ids, END] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint16, int(counts.sum())), counts

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.chars > MOST_CHARS:
            self._forget()
        elif len(self.known) > self.most:
            self._shrink()
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            n = len(self.known)
            self._learn([distinct[x] for x in new.tolist()])
            place[new] = np.arange(n, n + len(new))
        self.met[place] += 1
        at = np.asarray(coded.indices)
        lengths = self.lengths[place][at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.arena[np.repeat(self.starts[place][at] - ends[:-1], lengths) + np.arange(int(ends[-1]))]
        upto = ends[np.asarray(words.offsets)]
        return np.insert(ids, upto[1:], END), np.diff(upto) + 1


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> Encoder:
    """The encoder of a worker, which later tasks use again with the words it knows."""
    return Encoder(path)


def _group(ids: np.ndarray, counts: np.ndarray, docs: list[int | None]) -> bytes:
    used, scaled, blocks = encode(ids, BLOCK)
    code = b"".join(x for _, _, x in blocks)
    table = np.array([(n, crc, len(x)) for n, crc, x in blocks], "<u4").tobytes()
    names = np.array([np.iinfo(np.int64).min if x is None else x for x in docs], "<i8").tobytes() + bytes(x is None for x in docs)
    held = zlib.compress(used.astype("<u2").tobytes() + scaled.astype("<u4").tobytes())
    return MAGIC + struct.pack("<5I", len(docs), len(ids), len(blocks), len(held), len(code)) + names + counts.astype("<u4").tobytes() + held + table + code


def groups(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(documents, numbers of ids, ids) of each group of an open file."""
    while magic := source.read(len(MAGIC)):
        if magic != MAGIC:
            raise ValueError("not a token file, or a damaged one")
        n_docs, n_ids, n_blocks, n_held, _ = struct.unpack("<5I", source.read(20))
        names = np.frombuffer(source.read(8 * n_docs), "<i8").tolist()
        docs = [None if flag else x for x, flag in zip(names, source.read(n_docs))]
        counts = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)
        held = zlib.decompress(source.read(n_held))
        n = len(held) // 6
        table = np.frombuffer(source.read(12 * n_blocks), "<u4").reshape(-1, 3).tolist()
        ids = decode(np.frombuffer(held, "<u2", n), np.frombuffer(held, "<u4", n, 2 * n), [(n, crc, source.read(length)) for n, crc, length in table])
        if len(ids) != n_ids or counts.sum() != n_ids:
            raise ValueError("a group's numbers of ids don't add up")
        yield docs, counts, ids


def _writer(folder: str, path: str | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path is None:
            import public_tokenizers

        store, root = _store(folder)
        name, sink, encoder, total, n_docs = f"{uuid.uuid4().hex}.ids", None, None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                sink.write(_group(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [d for x in held for d in x[2]]))
            held, size = [], 0

        for batch in parts(batches, "text", most_bytes=4 << 20, most_rows=10_000):
            if sink is None:
                sink = store.open_output_stream(f"{root}/{name}")
                held_at = path or public_tokenizers.path("word_bpe_49k.json")
                encoder = _encoder(str(held_at), os.stat(held_at).st_mtime_ns)
            ids, counts = encoder.of(batch.column("text"))
            if size and size + len(ids) > GROUP:
                flush()
            held.append((ids, counts, batch.column("id").to_pylist()))
            size += len(ids)
            total += len(ids)
            n_docs += len(counts)
        if sink is not None:
            flush()
            sink.close()
            yield pa.RecordBatch.from_pydict({"place": [TaskContext.get().partitionId()], "file": [name], "ids": [total], "documents": [n_docs]}, _INDEX)

    return write


_INDEX = pa.schema([("place", pa.int32()), ("file", pa.string()), ("ids", pa.int64()), ("documents", pa.int64())])


def write(docs: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", path: str | None = None, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents; returns (file, start, ids, documents): the files under `folder` and the ids before each.

    Files stand in the order of the ranges they hold.  There are as many ranges as
    shuffle partitions, and more where a range would hold above `TASK_BYTES`.
    """
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = estimate if estimate < 1 << 55 else 0  # Spark says 2 ** 63 - 1 where it can't tell
    n = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // TASK_BYTES))
    # Rows of one id, null or not, may be many, so ranges also cut between their texts.
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    index = settled(rows.mapInArrow(_writer(folder, path), "place int, file string, ids long, documents long"), f"{folder}-index")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return index.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "ids", "documents")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as source:
                    for docs, counts, ids in groups(source):
                        wide = ids.astype("<u4")
                        ends = np.cumsum(counts)
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += len(ids)

    return read


def read(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    return index.repartition(max(1, index.count()), "file").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = f"{scratch(docs.sparkSession)}/ids"
    out = settled(read(settled(write(docs, folder, path=path), f"{folder}-starts"), folder), f"{folder}-out")
    drop_folder(docs.sparkSession, folder, f"{folder}-index", f"{folder}-starts")
    return out
