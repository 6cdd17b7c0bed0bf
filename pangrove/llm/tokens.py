"""Token counts and token-id files with a public byte-level tokenizer.

Both operators split a text into pre-tokens and ask the tokenizer's model for
each distinct pre-token once.  Texts whose characters all have settled classes
(Latin scripts and punctuation below U+0250) are split here; any other text is
split by the tokenizer's own pre-tokenizer.  The strings of special tokens are
cut out first, and stand for themselves.  No text is encoded whole, unless a
tokenizer is not of the byte-level kind.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pangrove.llm.common import shared_dir, store, written

#: The pre-token pattern of the byte-level tokenizer, for the
#: characters that UNSETTLED lets through.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNSETTLED = re.compile("[^\t-\r -~\x80-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")

#: Before a pre-token in the byte-level alphabet, and before a special token's string.
SPELLED, SPECIAL = "\x00", "\x01"

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 800_000


class Encoder:
    """A tokenizers file with a memory of pre-tokens; one for each worker and file."""

    _open: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, specials))})") if specials else None
        self.special_ids = {t["content"]: t["id"] for t in added}
        #: Whether pre-tokens can be taken apart: no normalizer, the byte-level split, plain special tokens.
        self.by_piece = (
            spec.get("normalizer") is None
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec["model"]["type"] == "BPE"
        )
        #: The byte-level alphabet: printable bytes as they are, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spell = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.ids_below = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, np.ndarray | bytes | int] = {}

    @classmethod
    def at(cls, path: str, use: str) -> Encoder:
        """A worker's encoder for one use: counts and ids are remembered apart."""
        if (path, use) not in cls._open:
            cls._open.clear()
            cls._open[path, use] = cls(path)
        return cls._open[path, use]

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None if only the tokenizer can tell.

        Those of the tokenizer's own split come in the byte-level alphabet
        behind SPELLED, special tokens behind SPECIAL; neither sign is settled,
        so no pre-token that is split here begins with one.
        """
        if not self.by_piece:
            return None
        if not UNSETTLED.search(text) and not (self.special and self.special.search(text)):
            return PIECES.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(SPECIAL + part)
            elif UNSETTLED.search(part):
                out += [SPELLED + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += PIECES.findall(part)
        return out

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, words: set[str], value) -> None:
        """Remember ``value(ids)`` of each word."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        # A pre-token is one word to the library's model: its bytes in the byte-level alphabet.
        merge, spell = self.library.model.tokenize, self.spell
        for word in words:
            if word[0] == SPECIAL:
                self.known[word] = value([self.special_ids[word[1:]]])
                continue
            if word[0] == SPELLED:
                spelled = word[1:]
            elif word.isascii() and word.isprintable():
                spelled = word.replace(" ", "\u0120")
            else:
                spelled = word.encode("utf-8").decode("latin-1").translate(spell)
            self.known[word] = value([t.id for t in merge(spelled)])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: distinct pre-tokens joined to each text's frequencies."""
        freqs = [None if p is None else Counter(p) for p in map(self.pieces, texts)]
        self.learn({w for f in freqs if f for w in f if w not in self.known}, len)
        out = []
        for text, freq in zip(texts, freqs):
            if freq is None:
                out.append(len(self.whole(text)))
                continue
            if not freq.keys() <= self.known.keys():  # the memory was begun anew
                self.learn(set(freq), len)
            known = self.known
            out.append(sum(known[w] * n for w, n in freq.items()))
        return out

    def encode(self, texts: list[str], dtype: np.dtype) -> Iterator[bytes]:
        """Each text's ids, packed as ``dtype``."""
        pack = lambda ids: np.array(ids, dtype).tobytes()
        split = [self.pieces(t) for t in texts]
        self.learn({w for p in split if p for w in p if w not in self.known}, pack)
        for text, words in zip(texts, split):
            if words is None:
                yield pack(self.whole(text))
                continue
            try:
                yield b"".join(map(self.known.__getitem__, words))
            except KeyError:  # the memory was begun anew
                self.learn(set(words), pack)
                yield b"".join(map(self.known.__getitem__, words))


def _chunks(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of about ``most`` characters, with where they begin."""
    begin, texts, size = 0, [], 0
    for k, value in enumerate(batch.column(column)):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield begin, texts
            begin, texts, size = k + 1, [], 0
    if texts:
        yield begin, texts


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    Pieces are counted once for each distinct pre-token that a worker meets (it
    remembers ``REMEMBERED`` of them), joined to each text's pre-token
    frequencies and summed; ids of texts are never built, and nothing is
    shuffled.  A null text counts as empty (0
    tokens).  Rows are independent: ties, repeated rows and null ids come out
    as they came in, an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = Encoder.at(path, "counts")
        for batch in batches:
            for begin, texts in _chunks(batch, 1):
                tokens = np.array(encoder.count(texts), np.int64)
                sizes = np.array([len(t.encode("utf-8")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


# ---- token-id files -------------------------------------------------------

#: Sequences in a record batch of a token file.
SEQUENCES = 512


def id_dtype(ids_below: int) -> np.dtype:
    return np.dtype("<u2") if ids_below <= 1 << 16 else np.dtype("<u4")


class SequenceWriter:
    """One part: a file of equal-length sequences with masks, and a file of its documents.

    ``tokens`` is a fixed-size list of ids, ``mask`` a fixed-size list of
    booleans, false behind the part's last id.  Both are plain Arrow files, so
    sequence ``k`` is row ``k % SEQUENCES`` of batch ``k // SEQUENCES``, mapped
    without a copy.
    """

    def __init__(self, uri: str, length: int, dtype: np.dtype, id_type: pa.DataType):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("doc_id", id_type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        fs, path = store(uri)
        self.outs = [fs.open_output_stream(f"{path}.tokens.arrow"), fs.open_output_stream(f"{path}.docs.arrow")]
        self.file = pa.ipc.new_file(self.outs[0], self.schema)
        self.docs = pa.ipc.new_file(self.outs[1], self.doc_schema)
        self.buffer, self.held, self.tokens, self.n_docs = [], 0, 0, 0

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.buffer), self.dtype)
        block = self.length * SEQUENCES
        cut = len(data) if last else len(data) // block * block
        for k in range(0, cut, block):
            part = data[k : min(k + block, cut)]
            rows = -(-len(part) // self.length)
            mask = np.zeros(rows * self.length, bool)
            mask[: len(part)] = True
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(part)] = part
            self.file.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(full), self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    ],
                    schema=self.schema,
                )
            )
        self.buffer = [data[cut:].tobytes()] if cut < len(data) else []
        self.held = len(data) - cut

    def add(self, ids: pa.Array, rows: list[bytes]) -> None:
        sizes = np.array([len(r) // self.dtype.itemsize for r in rows], np.int64)
        offsets = self.tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.docs.write_batch(
            pa.RecordBatch.from_arrays([ids, pa.array(offsets.astype(np.int64)), pa.array(sizes)], schema=self.doc_schema)
        )
        self.buffer += rows
        self.held += int(sizes.sum())
        self.tokens += int(sizes.sum())
        self.n_docs += len(rows)
        if self.held >= self.length * SEQUENCES:
            self._flush(last=False)

    def close(self) -> None:
        if self.held:
            self._flush(last=True)
        self.file.close()
        self.docs.close()
        for out in self.outs:
            out.close()


class SequenceReader:
    """Random access to one part; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        opened = [
            pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
            for p in (f"{path}.tokens.arrow", f"{path}.docs.arrow")
        ]
        self.file, self.docs = map(pa.ipc.open_file, opened)
        self.length = self.file.schema.field("tokens").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``k``'s ids (a view of the file) and mask."""
        batch = self.file.get_batch(k // SEQUENCES)
        row = k % SEQUENCES
        tokens = batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=True)
        return tokens, batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
        """Batches of documents: ids, offsets in the part, and each one's token ids."""
        at = -1
        flat = np.zeros(0)
        block = self.length * SEQUENCES
        for k in range(self.docs.num_record_batches):
            batch = self.docs.get_batch(k)
            offsets, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows = []
            for begin, size in zip(offsets.tolist(), sizes.tolist()):
                parts = []
                while size:
                    if begin // block != at:
                        at = begin // block
                        column = self.file.get_batch(at)
                        mask = column.column(1).flatten().to_numpy(zero_copy_only=False)
                        flat = column.column(0).flatten().to_numpy(zero_copy_only=True)[: int(mask.sum())]
                    take = min(size, block - begin % block)
                    parts.append(flat[begin % block : begin % block + take])
                    begin, size = begin + take, size - take
                rows.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16))
            yield batch.column(0), offsets, rows


def write_token_files(
    docs: DataFrame, path: str, out: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token files of ``docs`` in ascending id order below ``out``; returns their manifest.

    Documents are dealt by ranges of the id, so part ``k`` comes wholly before
    part ``k + 1``.  Each task encodes its documents, appends ``end_id`` to
    each, and writes one part under a name of its own attempt; only parts named
    in the manifest count, so a task that is lost or run twice does no harm.
    Manifest: ``(part, file, n_docs, n_tokens, start)``, ``start`` being the
    ids in earlier parts.  A null text is empty (its end id alone), null ids
    come first, rows with equal ids stand in the order of a hash of the text,
    then of the text, so reruns agree and one id can spread over parts.
    """
    id_type = docs.schema[id_col].dataType
    fs, root = store(out)
    fs.create_dir(root, recursive=True)

    def run(batches):
        context = TaskContext.get()
        encoder = Encoder.at(path, "ids")
        dtype = id_dtype(max(encoder.ids_below, end_id + 1))
        end = np.array([end_id], dtype).tobytes()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        writer = None
        for batch in batches:
            for begin, texts in _chunks(batch, 1):
                if writer is None:
                    writer = SequenceWriter(f"{out}/{name}", length, dtype, batch.column(0).type)
                writer.add(batch.column(0).slice(begin, len(texts)), [ids + end for ids in encoder.encode(texts, dtype)])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [context.partitionId()], "file": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.tokens]}
            )

    parts = (
        docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange("id", "mark")
        .sortWithinPartitions("id", "mark", "text")
        .select("id", "text")
        .mapInArrow(run, "part bigint, file string, n_docs bigint, n_tokens bigint")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    manifest = written(parts, "token-parts")
    return manifest.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint").alias("start"))


def read_token_files(manifest: DataFrame, out: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, part)`` of each document, read back from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned CRC-32 of its ids as little-endian 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for ids, offsets, rows in SequenceReader(f"{out}/{row['file']}").documents():
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(offsets + row["start"]),
                            pa.array([len(r) for r in rows], pa.int64()),
                            pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                            pa.array(np.full(len(rows), row["part"])),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    n = max(12, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        manifest.select("part", "file", "start")
        .repartition(n)
        .mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, part bigint")
    )


def token_digest(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` to token files in the shared folder and read them back, per document."""
    out = shared_dir(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, out, length, end_id)
    return read_token_files(manifest, out, docs.schema["doc_id"].dataType.simpleString())
