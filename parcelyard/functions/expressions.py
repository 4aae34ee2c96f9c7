"""Planning as column expressions: names, methods, chunks, pipelines, workers, offsets. Nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
#: extensions of compressed formats, which are stored if large: fixed values
STORED = ("zip", "7z", "rar", "gz", "bz2", "xz", "zst", "jpg", "jpeg", "png", "webp", "mp3", "mp4", "mkv", "avi")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ladder(value: Column, steps: list[tuple[int, Column | int]], otherwise) -> Column:
    """The result of the first step that ``value`` reaches."""
    out = None
    for least, result in steps:
        out = F.when(value >= least, result) if out is None else out.when(value >= least, result)
    return out.otherwise(otherwise)


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unsafe_path(name: Column) -> Column:
    """Empty, absolute, with a drive letter, or with a ``..`` part between slashes of either kind."""
    drive = (F.octet_length(F.substring(name, 1, 1)) == 1) & (F.substring(name, 2, 1) == ":")
    return (name == "") | F.substring(name, 1, 1).isin("/", "\\") | drive | F.array_contains(F.split(name, r"[/\\]"), "..")


def method_of(profile: Column) -> Column:
    return F.when(profile == "store", 0).otherwise(8)


def method_name(method: Column) -> Column:
    return F.when(method == 0, "store").when(method == 8, "deflate").otherwise("unknown")


def level_of(profile: Column) -> Column:
    return F.when(profile == "store", 0).when(profile == "small", 8).when(profile == "maximum", 9).otherwise(1)


def supported(method: Column) -> Column:
    return method.isin(0, 8)


def extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def prefers_store(path: Column, size: Column) -> Column:
    return (size >= 4 * MIB) & extension(path).isin(*STORED)


def adaptive_candidate(is_directory: Column, method: Column, size: Column) -> Column:
    return ~is_directory & (method == 8) & (size >= 8 * MIB)


def adaptive_threshold(profile: Column, size: Column) -> Column:
    """In thousandths of the sample."""
    return F.when((profile == "fast") & (size >= 64 * MIB), 830).otherwise(980)


def looks_incompressible(sample_size: Column, packed_size: Column, threshold: Column) -> Column:
    return (sample_size >= 256 * KIB) & (packed_size.cast("long") * 1000 >= sample_size * threshold)


def sample_of(content: Column, most: int = 2 * MIB) -> Column:
    """Head and tail halves of a long payload, or its head."""
    half = most // 2
    n = F.octet_length(content)
    return F.when(n > 2 * most, F.concat(F.substring(content, F.lit(1), F.lit(half)), F.substring(content, n - half + 1, F.lit(half)))).otherwise(F.substring(content, F.lit(1), F.lit(most)))


def chunk_size(size: Column, option: Column | int) -> Column:
    option = F.lit(option) if isinstance(option, int) else option
    return F.greatest(F.lit(64 * KIB), option.cast("long"), ladder(size, [(GIB, 32 * MIB), (256 * MIB, 16 * MIB), (64 * MIB, 8 * MIB), (16 * MIB, 4 * MIB)], 0).cast("long"))


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of numbers that aren't negative."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - a % b) / b).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    return F.when(a <= 0, F.lit(0).cast("long")).otherwise(_div(a - 1, b) + 1)


def chunk_count(size: Column, chunk: Column) -> Column:
    """Of the schedule: an empty entry is one chunk."""
    return F.greatest(F.lit(1).cast("long"), ceil_div(size, chunk))


def execution_path(is_directory: Column, encrypted: Column, method: Column) -> Column:
    return F.when(is_directory, "directory").when(encrypted, "prepared").when(method == 0, "store").otherwise("chunked-cpu")


def in_flight(memory_mb: Column, chunk: Column, override: Column | None = None) -> Column:
    budget = memory_mb.cast("long") * MIB
    fits = _div(budget, 2 * chunk)
    planned = F.when(memory_mb == 0, 32).otherwise(F.greatest(F.lit(1), F.least(F.lit(128), fits)))
    return planned if override is None else F.when(override > 0, F.least(override, F.lit(128))).otherwise(planned)


def tuned_chunk(total: Column, largest: Column, chunk: Column) -> Column:
    size = F.when((total >= 32 * GIB) | (largest >= 4 * GIB), 16 * MIB).when((total >= 8 * GIB) | (largest >= GIB), 8 * MIB).when(total >= 2 * GIB, 4 * MIB).otherwise(0)
    return F.greatest(chunk, size.cast("long"))


def tuned_in_flight(total: Column, largest: Column, planned: Column) -> Column:
    most = F.when((total >= 32 * GIB) | (largest >= 4 * GIB), 24).when((total >= 8 * GIB) | (largest >= GIB), 32).otherwise(128)
    return F.least(planned, most)


def mapped_limit(memory_mb: Column) -> Column:
    budget = memory_mb.cast("long") * MIB
    return F.when(memory_mb == 0, 0).when(memory_mb >= 4096, F.least(F.lit(3072 * MIB), budget - 256 * MIB)).when(memory_mb >= 2048, F.least(F.lit(1792 * MIB), budget - 128 * MIB)).otherwise(F.least(F.lit(1536 * MIB), _div(budget, 2)))


def mapped_eligible(method: Column, size: Column, memory_mb: Column) -> Column:
    return (method == 8) & (size >= 32 * MIB) & (size <= mapped_limit(memory_mb))


def streaming_eligible(method: Column, packed: Column) -> Column:
    return (method == 8) & (packed <= MAX32)


def extract_path(method: Column, encrypted: Column, size: Column, packed: Column, memory_mb: Column, progress: bool = False) -> Column:
    """Which way a buffer would be extracted; the first that fits."""
    plain = ~encrypted
    return (
        F.when((method == 0) & plain, "direct")
        .when(plain & streaming_eligible(method, packed) & F.lit(progress), "stream")
        .when(plain & mapped_eligible(method, size, memory_mb), "mapped")
        .when(plain & (method == 8) & (size >= 64 * MIB), "stream")
        .when(method == 8, "buffer")
        .otherwise("decode")
    )


def parallelism_score(method: Column, size: Column, packed: Column, memory_mb: Column) -> Column:
    stored = ladder(size, [(256 * MIB, 8), (128 * MIB, 6), (64 * MIB, 4)], 2)
    return F.when(method == 0, stored).when(mapped_eligible(method, size, memory_mb), 9).when(streaming_eligible(method, packed) & (size >= 64 * MIB), 8).when((method == 8) & (size >= 8 * MIB), 4).otherwise(2)


def worker_count(files: Column, score: Column, total: Column, mapped: Column, streaming: Column, memory_mb: Column, chunk: Column, threads: Column, cores: Column) -> Column:
    """Workers for extraction and test, from sums over the files of an archive."""
    most = F.least(files, F.greatest(F.lit(1), threads), F.greatest(F.lit(1), cores - 2)).cast("long")
    by_memory = F.when(memory_mb == 0, most).otherwise(F.greatest(F.lit(1), _div(memory_mb.cast("long") * MIB, F.greatest(F.lit(48 * MIB), 3 * chunk))))
    io = F.when((mapped == files) & (total <= 2 * GIB), F.least(most, F.lit(4))).otherwise(most)
    io = F.when(streaming >= 2, F.least(io, F.greatest(F.lit(2), streaming))).otherwise(io)
    out = F.greatest(F.lit(1), F.least(most, F.greatest(F.lit(1), _div(score + 7, 8)), F.greatest(F.lit(1), ceil_div(total, F.lit(64 * MIB))), by_memory, io))
    return F.when(files <= 1, files).when(most <= 1, most).otherwise(out).cast("long")


def local_record_size(name: Column, packed: Column, flag: Column) -> Column:
    return 30 + F.octet_length(name).cast("long") + packed + F.when(flag.bitwiseAND(F.lit(8)) != 0, 16).otherwise(0)


def directory_record_size(name: Column, offset: Column) -> Column:
    return 46 + F.octet_length(name).cast("long") + F.when(offset > MAX32, 12).otherwise(0)


def needs_zip64(count: Column, size: Column, offset: Column) -> Column:
    return (count > MAX16) | (size > MAX32) | (offset > MAX32)


def expansion_x100(size: Column, packed: Column) -> Column:
    return F.when(packed == 0, 100).otherwise(_div(size * 100, F.greatest(packed, F.lit(1)))).cast("long")


def human_bytes(n: Column) -> Column:
    """In steps of 1024 up to TB; no decimals from 100 on, or for bytes. Halves go to the even digit, as in C's printf (``rint``), and all quotients are exact."""
    n = n.cast("long")

    def shown(bits: int, unit: str) -> Column:
        tenths = F.rint(n.cast("double") * 10 / F.lit(float(1 << bits))) / 10  # only of numbers under 2^47
        low = n.bitwiseAND(F.lit((2 << bits) - 1))
        whole = F.shiftright(n - low, bits) + F.rint(low / F.lit(float(1 << bits))).cast("long")
        return F.concat(F.when(n >= 100 << bits, whole.cast("string")).otherwise(tenths.cast("string")), F.lit(f" {unit}"))

    return ladder(n, [(1 << bits, shown(bits, unit)) for bits, unit in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB"))], F.concat(n.cast("string"), F.lit(" B")))


def list_line(is_directory: Column, size: Column, packed: Column, method: Column, encrypted: Column, crc: Column, name: Column) -> Column:
    return F.format_string("%s %10d %10d method=%s(%d) encrypted=%s crc=0x%08x %s", F.when(is_directory, "dir ").otherwise("file"), size, packed, method_name(method), method, F.when(encrypted, "yes").otherwise("no"), crc, name)


def extraction_root(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")
