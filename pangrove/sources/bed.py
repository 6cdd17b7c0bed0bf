"""Rows as range-indexed text: BGZF blocks written by tasks, and readers of such files."""

from __future__ import annotations

import struct
import zlib

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the BGZF format: the block's header, its longest payload, the empty block that ends a file.
HEADER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
PAYLOAD = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One BGZF block of ``data``; stored where that is shorter than deflated."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    if len(body) > len(data) + 5:
        body = b"\x01" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
    return HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bgzf(rows: DataFrame, path: str, header: str = "") -> None:
    """``(seq, start_pos, line)`` rows, sorted, as one BGZF file.

    Tasks sort their range of the order and write their blocks as part files
    beside the target; one more task then strings the parts together by
    streams, never holding one whole.  A part counts by the name its task
    returns, so a task that runs twice leaves only a spare file.
    """
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    fs.create_dir(f"{name}.parts", recursive=True)

    def run(batches):
        import pyarrow as pa

        context = TaskContext.get()
        part = f"{name}.parts/{context.partitionId():06d}-{context.taskAttemptId()}"
        out, held, size = None, [], 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append(line.encode() + b"\n")
                size += len(held[-1])
                while size >= PAYLOAD:
                    data = b"".join(held)
                    out = out or fs.open_output_stream(part)
                    out.write(bgzf_block(data[:PAYLOAD]))
                    held, size = [data[PAYLOAD:]], size - PAYLOAD
        if size:
            out = out or fs.open_output_stream(part)
            out.write(bgzf_block(b"".join(held)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part]})

    ordered = rows.repartitionByRange("seq", "start_pos", "line").sortWithinPartitions("seq", "start_pos", "line").select("line")
    parts = sorted(r.part for r in ordered.mapInArrow(run, "part string").collect())  # a name for each task

    def join(batches):
        import pyarrow as pa

        made = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        for _ in batches:
            pass
        with fs.open_output_stream(made) as out:
            if header:
                out.write(bgzf_block(header.encode()))
            for part in parts:
                with fs.open_input_stream(part) as piece:
                    while chunk := piece.read(1 << 20):
                        out.write(chunk)
            out.write(END)
        yield pa.RecordBatch.from_pydict({"made": [made]})

    made = rows.sparkSession.range(0, 1, 1, 1).mapInArrow(join, "made string").first().made
    fs.move(made, name)
    fs.delete_dir(f"{name}.parts")


def read_bed(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``(pos, line)`` text as string columns; ``#`` lines are skipped, surplus fields dropped."""
    c = F.split("line", "\t")
    rows = lines.where(~F.startswith("line", F.lit("#")) & (F.col("line") != ""))
    return rows.select("pos", *[F.get(c, k).alias(n) for k, n in enumerate(columns)])


def as_text(rows: DataFrame, seq: str = "chrom", start: str = "start_pos") -> DataFrame:
    """Any rows as ``(seq, start_pos, line)`` text, all columns in their order; ``write_bgzf`` takes it."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(".")) for c in rows.columns]
    return rows.select(F.col(seq).alias("seq"), F.col(start).cast("bigint").alias("start_pos"), F.concat_ws("\t", *fields).alias("line"))


# ---- tabix indexes ------------------------------------------------------------

#: Fixed values of the index formats: magic, BED's column numbers, the bits of the smallest bin and the depth of each.
TBI_MAGIC, CSI_MAGIC = b"TBI\x01", b"CSI\x01"
BED_COLUMNS = (0x10000, 1, 2, 3, ord("#"), 0)
SHIFT, DEPTH = 14, 5


def _bin(begin: int, end: int, shift: int, depth: int) -> int:
    """The smallest bin that holds ``[begin, end)``."""
    level = next((d for d in range(depth, 0, -1) if begin >> (shift + 3 * (depth - d)) == (end - 1) >> (shift + 3 * (depth - d))), 0)
    return ((1 << 3 * level) - 1) // 7 + (begin >> (shift + 3 * (depth - level)))


def write_tabix(path: str) -> str:
    """An index beside a sorted BGZF file of BED rows; its path.

    ``.tbi``, or ``.csi`` where a row ends beyond 2**29.  The file is read once,
    block by block, by one task's worth of work; what is held is the index.
    """
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    rows, names = [], []  # (sequence, start, end, virtual offsets)
    with fs.open_input_file(name) as f:
        size, at, rest, rest_at = f.size(), 0, b"", 0
        while at < size:
            f.seek(at)
            head = f.read(18)
            length = struct.unpack("<H", head[16:18])[0] + 1
            data = zlib.decompress(f.read(length - 26), -15)
            used = 0
            while (stop := data.find(b"\n", used)) >= 0:
                line, begin = (rest + data[used:stop], rest_at) if rest else (data[used:stop], at << 16 | used)
                rest, used = b"", stop + 1
                end = at << 16 | used if used < len(data) else (at + length) << 16
                if line and line[:1] != b"#":
                    c = line.split(b"\t", 3)
                    if not names or names[-1] != c[0]:
                        names.append(c[0])
                    rows.append((len(names) - 1, int(c[1]), int(c[2]), begin, end))
            if used < len(data):
                rest, rest_at = rest + data[used:], rest_at if rest else at << 16 | used
            at += length
    depth, wide = DEPTH, max((r[2] for r in rows), default=0)
    csi = wide > 1 << (SHIFT + 3 * DEPTH)
    while wide > 1 << (SHIFT + 3 * depth):
        depth += 1
    title = b"".join(n + b"\x00" for n in names)
    meta = struct.pack("<6i", *BED_COLUMNS) + struct.pack("<i", len(title)) + title
    out = [CSI_MAGIC + struct.pack("<3i", SHIFT, depth, len(meta)) + meta + struct.pack("<i", len(names)) if csi else TBI_MAGIC + struct.pack("<i", len(names)) + meta]
    for k in range(len(names)):
        bins: dict[int, list[list[int]]] = {}
        first: dict[int, int] = {}
        linear: list[int] = []
        for _, a, b, begin, end in (r for r in rows if r[0] == k):
            b = max(b, a + 1)
            here = _bin(a, b, SHIFT, depth)
            chunks = bins.setdefault(here, [])
            first.setdefault(here, begin)
            if chunks and chunks[-1][1] == begin:
                chunks[-1][1] = end
            else:
                chunks.append([begin, end])
            for w in range(a >> SHIFT, ((b - 1) >> SHIFT) + 1) if not csi else ():
                linear += [0] * (w + 1 - len(linear))
                linear[w] = linear[w] or begin
        out.append(struct.pack("<i", len(bins)))
        for number, chunks in sorted(bins.items()):
            out.append(struct.pack("<I", number) + (struct.pack("<Q", first[number]) if csi else b"") + struct.pack("<i", len(chunks)))
            out += [struct.pack("<QQ", *c) for c in chunks]
        if not csi:
            for w in range(1, len(linear)):
                linear[w] = linear[w] or linear[w - 1]
            out.append(struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear))
    data = b"".join(out)
    made = f"{name}.{'csi' if csi else 'tbi'}"
    for old in (f"{name}.csi", f"{name}.tbi"):  # an index of an older file must not stay
        if fs.get_file_info(old).type == pafs.FileType.File:
            fs.delete_file(old)
    with fs.open_output_stream(f"{made}.tmp") as f:
        for k in range(0, len(data), PAYLOAD):
            f.write(bgzf_block(data[k : k + PAYLOAD]))
        f.write(END)
    fs.move(f"{made}.tmp", made)
    return made
