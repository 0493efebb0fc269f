"""Runs of spectra as a data source of their own: mzML, mzXML and binary scans, read in ranges.

A plain mzML or mzXML file is dealt into ranges of bytes; the spectra whose start tag lies in a range
belong to it, so a file needs no index, no task reads more than its range and the end of its last
spectrum, and a file of any size is read by as many tasks. Chosen scans are looked up in the file's
own index (the list of offsets at its end) and read one by one; where the index is missing or points
elsewhere they are found by reading the ranges. Packed files (.gz) and binary scans have no place to
begin but their start: one task streams each. Files are opened through Arrow's file systems, by any
address that these know (local, HDFS, S3, GCS).

``write_binary`` writes binary scans: a task writes whole runs to a hidden folder, and only the commit
of the whole job moves them into place; where it fails, they are removed.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPECTRUM = "file string, scan long, ms_level int, charge int, parent_mz double, rt double, peaks array<struct<mz:double,intensity:double>>"
#: Bytes of a range, of what is read at once, and spectra of a batch.
RANGE, BLOCK, BATCH = 64 << 20, 4 << 20, 200
#: Start of a spectrum by the ending of the file.
STARTS = {"mzml": re.compile(rb"<spectrum[\s>]"), "mzxml": re.compile(rb"<scan[\s>]")}
BINARY = ("bms1", "bms2", "cms1", "cms2")
#: Bytes at the start of a file in which groups of parameters are looked for.
HEAD = 1 << 20


def opened(address: str):
    """The file system of an address and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:/") else (fs.LocalFileSystem(), address)


def kind_of(path: str) -> str:
    return path.lower().removesuffix(".gz").rsplit(".", 1)[-1]


def addresses(address: str, kinds=(*STARTS, *BINARY)) -> list[tuple[str, int]]:
    """The files of an address, or of a folder, with their sizes, by name."""
    from pyarrow import fs

    system, path = opened(address)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(address)
    if info.type == fs.FileType.File:
        return [(address, info.size)]
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((f"{address.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and kind_of(f.path) in kinds)


class Reading:
    """Bytes of a file or of an unpacked stream from a place on, as far as they are asked for."""

    def __init__(self, address: str, at: int = 0):
        system, path = opened(address)
        if address.lower().endswith(".gz"):
            self.stream = system.open_input_stream(path, compression="gzip")
        else:
            self.stream = system.open_input_file(path)
            self.stream.seek(at)
        self.base, self.held = at, b""

    def more(self) -> bool:
        block = self.stream.read(BLOCK)
        self.held += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.base, self.held = self.base + n, self.held[n:]

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = self.held[:n]
        self.drop(len(out))
        return out


def elements(address: str, kind: str, start: int, end: int | None):
    """The text of each spectrum whose start tag lies between two places of a file. In mzXML a scan ends
    where the next begins inside it, as a scan's peaks come before the scans that it holds."""
    reading, opens = Reading(address, start), STARTS[kind]
    closes = re.compile(rb"</spectrum>") if kind == "mzml" else re.compile(rb"</scan>|<scan[\s>]")
    while True:
        found = opens.search(reading.held)
        while not found:
            reading.drop(max(len(reading.held) - 16, 0))
            if end is not None and reading.base >= end or not reading.more():
                return
            found = opens.search(reading.held)
        if end is not None and reading.base + found.start() >= end:
            return
        reading.drop(found.start())
        at = 5
        while not (last := closes.search(reading.held, at)):
            at = max(len(reading.held) - 16, 5)
            if not reading.more():
                return  # cut off
        if kind == "mzml":
            yield reading.held[: last.end()]
            reading.drop(last.end())
        else:
            yield reading.held[: last.start()] + b"</scan>"
            reading.drop(last.start())


def groups_of(address: str) -> dict[str, list]:
    """Parameters of the groups that spectra refer to, by group, from the head of an mzML file."""
    import xml.etree.ElementTree as ET

    head = Reading(address).read(HEAD)
    found = re.findall(rb"<referenceableParamGroup\s[^>]*id=\"([^\"]*)\"[^>]*>(.*?)</referenceableParamGroup>", head, re.S)
    return {name.decode(): list(ET.fromstring(b"<g>" + body + b"</g>")) for name, body in found}


def index_of(address: str, kind: str, size: int) -> dict[int, int] | None:
    """Where each scan begins, by the index at the end of a file; None without one."""
    tail_at = max(size - 4096, 0)
    tail = Reading(address, tail_at).read(4096)
    last = re.search(rb"<indexListOffset>\s*(\d+)" if kind == "mzml" else rb"<indexOffset>\s*(\d+)", tail)
    if not last or int(last[1]) >= size:
        return None
    text = Reading(address, int(last[1])).read(size - int(last[1]))
    if kind == "mzml":
        part = re.search(rb"<index\s[^>]*name=\"spectrum\".*?</index>", text, re.S)
        pairs = re.findall(rb"<offset\s[^>]*idRef=\"([^\"]*)\"[^>]*>\s*(\d+)", part[0] if part else b"")
        named = [(re.search(rb"scan=(\d+)", name), int(at)) for name, at in pairs]
        out = {int(m[1]) if m else k: at for k, (m, at) in enumerate(named, 1)}
    else:
        out = {int(k): int(at) for k, at in re.findall(rb"<offset\s[^>]*id=\"(\d+)\"[^>]*>\s*(\d+)", text)}
    if not out or any(at >= size for at in out.values()):
        return None
    first = min(out.values())
    return out if STARTS[kind].match(Reading(address, first).read(16)) else None


@dataclass
class Part(InputPartition):
    """Some bytes of a file: a range, or single places; or the whole stream of a packed or binary one."""

    address: str
    kind: str
    start: int = 0
    end: int | None = None
    places: tuple[int, ...] | None = None


class RunReader(DataSourceReader):
    def __init__(self, options):
        self.address, self.range = options["path"], int(options.get("rangeBytes", RANGE))
        level, numbers = options.get("level"), options.get("scans")
        self.level, self.numbers = int(level) if level else None, frozenset(map(int, numbers.split(","))) if numbers else None

    def partitions(self):
        out = []
        for address, size in addresses(self.address):
            kind = kind_of(address)
            if kind in BINARY or address.lower().endswith(".gz"):
                out.append(Part(address, kind))
                continue
            index = index_of(address, kind, size) if self.numbers is not None else None
            if index is not None:
                places = sorted(index[n] for n in self.numbers if n in index)
                out += [Part(address, kind, places=tuple(places[k : k + BATCH])) for k in range(0, len(places), BATCH)]
            else:
                out += [Part(address, kind, at, min(at + self.range, size)) for at in range(0, size, self.range)]
        return out or [Part("", "")]

    def spectra(self, part: Part):
        import xml.etree.ElementTree as ET

        from spectraloom.sources import spectra

        if not part.kind:
            return
        if part.kind in BINARY:
            yield from spectra.parse_binary(Reading(part.address), part.kind[0] == "c", int(part.kind[-1]))
            return
        ranges = [(part.start, part.end)] if part.places is None else [(at, at + 1) for at in part.places]
        groups = groups_of(part.address) if part.kind == "mzml" else {}
        for start, end in ranges:
            for text in elements(part.address, part.kind, start, end):
                node = ET.fromstring(text)
                yield spectra.mzml_spectrum(node, groups) if part.kind == "mzml" else spectra.mzxml_spectrum(node)

    def read(self, partition):
        rows = []
        for row in self.spectra(partition):
            if (self.level is None or row[1] == self.level) and (self.numbers is None or row[0] in self.numbers):
                rows.append(row)
            if len(rows) == BATCH:
                yield batch_of(partition.address, rows)
                rows = []
        if rows:
            yield batch_of(partition.address, rows)


def batch_of(address: str, rows: list):
    """Rows (scan, level, charge, parent m/z, seconds, m/z, intensities) as a batch, arrays as they are."""
    import numpy as np
    import pyarrow as pa

    scan, level, charge, parent, rt, mz, height = zip(*rows)
    n = [min(len(x), len(y)) for x, y in zip(mz, height)]
    flat = [np.concatenate([np.asarray(x, float)[:k] for x, k in zip(values, n)]) if n else np.zeros(0) for values in (mz, height)]
    peaks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["mz", "intensity"]))
    columns = [pa.array([address] * len(rows)), pa.array(scan, pa.int64()), pa.array(level, pa.int32()), pa.array(charge, pa.int32()), pa.array(parent, pa.float64()), pa.array(rt, pa.float64()), peaks]
    return pa.RecordBatch.from_arrays(columns, ["file", "scan", "ms_level", "charge", "parent_mz", "rt", "peaks"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class BinaryWriter(DataSourceArrowWriter):
    """One file for each run of a task; a task has whole runs, in the order of their scans."""

    def __init__(self, options, overwrite: bool):
        self.address, self.ending, self.overwrite = options["path"].rstrip("/"), options["ending"], overwrite
        self.token = uuid.uuid4().hex

    def write(self, iterator):
        import numpy as np

        system, path = opened(self.address)
        hidden = f"{path}/.{self.token}"
        system.create_dir(hidden)
        packed, files, out, now = self.ending[0] == "c", [], None, None
        for batch in iterator:
            at = {name: batch.column(name) for name in ("run", "scan", "charge", "parent_mz", "rt", "peaks")}
            for i in range(batch.num_rows):
                run = at["run"][i].as_py()
                if run != now:
                    if out:
                        out.close()
                    now, temporary = run, f"{hidden}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    out.write(struct.pack("<ii", BINARY_TYPES[self.ending], 5) + bytes(16 * 128))
                    files.append((temporary, f"{path}/{run}.{self.ending}"))
                peaks = at["peaks"][i].values
                mz, height = (np.asarray(peaks.field(name) if peaks is not None else [], "<f8") for name in ("mz", "intensity"))
                scan, charge, parent, rt = (at[name][i].as_py() for name in ("scan", "charge", "parent_mz", "rt"))
                out.write(record(scan, charge or 0, parent, rt or 0.0, mz, height, packed))
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, path = opened(self.address)
        for message in messages:
            for temporary, final in message.files if message else ():
                system.move(temporary, final)
        self.clear()

    def abort(self, messages):
        self.clear()

    def clear(self):
        from pyarrow import fs

        system, path = opened(self.address)
        if system.get_file_info(f"{path}/.{self.token}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/.{self.token}")


#: The type that the head of a binary file of scans names.
BINARY_TYPES = {"bms1": 1, "cms1": 2, "bms2": 3, "cms2": 4}


def record(scan: int, charge: int, parent: float | None, seconds: float, mz, height, packed: bool) -> bytes:
    """A binary scan of version 5: numbers, precursors, times and sums, its charge, its peaks."""
    import numpy as np

    top = int(height.argmax()) if len(height) else 0
    parents = [parent] if parent is not None else []
    mass = [(charge, parent * charge - (charge - 1) * 1.00727646688)] if charge and parents else []
    out = struct.pack("<iii", scan, scan, len(parents)) + b"".join(struct.pack("<d", x) for x in parents)
    out += struct.pack("<ff", seconds / 60, height[top] if len(height) else 0.0) + struct.pack("<d", mz[top] if len(mz) else 0.0) + bytes(6 * 8)
    out += struct.pack("<df", float(height.sum()), 0.0) + struct.pack("<iii", len(mass), 0, len(mz)) + b"".join(struct.pack("<id", *x) for x in mass)
    if packed:
        a, b = zlib.compress(mz.astype("<f8").tobytes()), zlib.compress(height.astype("<f4").tobytes())
        return out + struct.pack("<ii", len(a), len(b)) + a + b
    both = np.empty(len(mz), np.dtype([("mz", "<f8"), ("height", "<f4")]))
    both["mz"], both["height"] = mz, height
    return out + both.tobytes()


class Runs(DataSource):
    @classmethod
    def name(cls):
        return "runs"

    def schema(self):
        return SPECTRUM

    def reader(self, schema):
        return RunReader(self.options)

    def writer(self, schema, overwrite):
        return BinaryWriter(self.options, overwrite)


def read(spark: SparkSession, address: str, level: int | None = None, scans: list[int] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Spectra of a file, or of all such files of a folder: of one level, or chosen by their numbers."""
    spark.dataSource.register(Runs)
    options = {"rangeBytes": str(range_bytes)} | ({"level": str(level)} if level else {}) | ({"scans": ",".join(map(str, scans))} if scans is not None else {})
    if scans is not None and not scans:
        return spark.createDataFrame([], SPECTRUM)
    return spark.read.format("runs").options(**options).load(address)


def write_binary(scans: DataFrame, address: str, ending: str, run: str = "file") -> None:
    """Scans (run, scan, charge, parent_mz, rt in seconds, peaks) as binary files, one for each run, plain
    (bms1, bms2) or packed (cms1, cms2). Files of the same names are replaced."""
    if ending not in BINARY_TYPES:
        raise ValueError(f"no binary scans end in {ending}")
    name = F.regexp_replace(F.regexp_replace(F.col(run).cast("string"), r"^.*/", ""), r"\.[^.]*$", "")
    numbers = ("scan", "long"), ("charge", "int"), ("parent_mz", "double"), ("rt", "double")
    peaks = F.transform("peaks", lambda p: F.struct(p["mz"].cast("double").alias("mz"), p["intensity"].cast("double").alias("intensity")))
    rows = scans.select(name.alias("run"), *(F.col(c).cast(kind).alias(c) for c, kind in numbers), peaks.alias("peaks"))
    spark = scans.sparkSession
    spark.dataSource.register(Runs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "run").sortWithinPartitions("run", "scan").write.format("runs").mode("append").options(ending=ending).save(address)
