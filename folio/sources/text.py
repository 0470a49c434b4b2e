"""Broker files as rows (file, content) and their lines.

One file is one row: an import is at most 10 MB, so detection, header search and
line numbers need no shuffle, and files spread over the cluster.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import trimmed
from ..tables import small_methods

# Windows-1250, upper half; bytes without a character decode to U+FFFD.
_UPPER_BYTES = "".join(chr(b) for b in range(0x80, 0x100))
_UPPER_1250 = bytes(range(0x80, 0x100)).decode("cp1250", errors="replace")


def decode_broker_bytes(content: Column) -> Column:
    """UTF-8 if the bytes start with its mark, else Windows-1250."""
    marked = F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))
    return F.when(marked, F.decode(content, "UTF-8")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _UPPER_BYTES, _UPPER_1250))


def encode_1250(text: Column) -> Column:
    """Windows-1250 bytes of a text, the inverse of `decode_broker_bytes`."""
    pairs = [(b, c) for b, c in zip(_UPPER_BYTES, _UPPER_1250, strict=True) if c != "�"]
    return F.encode(F.translate(text, "".join(c for _, c in pairs), "".join(b for b, _ in pairs)), "ISO-8859-1")


@contextmanager
def _listed_by_few(spark: SparkSession):
    """While files are listed, a task lists many folders: by default it is a task for each of the first 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_broker_text(spark: SparkSession, paths: str | list[str], deep: bool = False) -> DataFrame:
    """One row per file, decoded. deep: files in folders at any depth, too, which the tasks list and not the driver."""
    with _listed_by_few(spark):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(paths)
    return raw.select(F.col("path").alias("file"), decode_broker_bytes(F.col("content")).alias("content"))


def raw_lines(content: Column) -> Column:
    return F.split(content, "\r?\n")


def filled_lines(content: Column) -> Column:
    """Lines of the trimmed content that are not empty."""
    return F.filter(raw_lines(trimmed(content)), lambda x: x != "")


# What stands for a line break, a carriage return and a separator inside quotes: noncharacters, which no text holds.
_SEALS = "\ufdd0\ufdd1\ufdd2"


def _states(codes: Column) -> Column:
    """From the codes of all quote runs: for every piece between them '1' inside a quoted cell, else '0'.

    A run opens (1), closes (0), keeps the state (i) or turns it (n); the last 1 or 0 decides, and how many turns follow it.
    """
    def resolved(segment: Column) -> Column:
        opens = F.startswith(segment, F.lit("1"))
        state = lambda k: F.when(opens != (k % 2 == 1), "1").otherwise("0")
        parts = F.transform(F.split(segment, "n"), lambda p, k: F.repeat(state(k), F.length(p) + F.when(k > 0, 1).otherwise(0)))
        return F.array_join(parts, "")

    return F.regexp_extract_all(F.array_join(F.transform(F.regexp_extract_all(F.concat(F.lit("0"), codes), F.lit("[01][in]*"), 0), resolved), ""), F.lit("."), 0)


def sealed(content: Column, sep: str) -> Column:
    """The content with line breaks and separators inside quoted cells masked, so that plain splits give records and cells.

    Split before runs of quotes; what stands on both sides of a run tells what it does (a quote behind a separator opens, one before a
    separator closes, pairs are quotes of the cell, and one with text on both sides is part of it). Every step is linear in the file.
    """
    tokens = F.regexp_extract_all(F.concat(F.lit("\n"), content, F.lit("\n")), F.lit('"*[^"]+'), 0)

    def sides(token: Column) -> Column:
        """B: a border follows the run; O: the run is odd; A: a border ends the token. Small letters: not so."""
        rest = F.ltrim(token, F.lit('"'))
        start = F.substring(F.ltrim(rest, F.lit(" \t")), 1, 1).isin(sep, "\n", "\r")
        end = F.substring(F.rtrim(rest, F.lit(" \t")), -1, 1).isin(sep, "\n")
        odd = (F.length(token) - F.length(rest)) % 2 == 1
        return F.concat(F.when(start, "B").otherwise("b"), F.when(odd, "O").otherwise("o"), F.when(end, "A").otherwise("a"))

    codes = F.substring(F.array_join(F.transform(tokens, sides), ""), 3, 2**31 - 1)  # A of the token before, B and O of a run, and so on
    for pattern, code in (("Ab[Oo]", "1"), ("aBO", "0"), ("ABO", "n"), ("[Aa][Bb][Oo]", "i"), ("[Aa]$", "")):
        codes = F.regexp_replace(codes, pattern, code)
    masked = F.zip_with(tokens, _states(codes), lambda t, s: F.when(s == "1", F.translate(t, "\n\r" + sep, _SEALS)).otherwise(t))
    whole = F.substring(F.array_join(masked, ""), 2, 2**31 - 1)
    return F.when(F.contains(content, F.lit('"')), F.regexp_replace(whole, r"\n\z", "")).otherwise(content)


def _bare(c: Column, sep: str) -> Column:
    """A piece of a record between separators without its quotes."""
    inner = F.regexp_replace(F.regexp_replace(c, r'^\s*"([\s\S]*)"\s*$', "$1"), '""', '"')
    return F.translate(inner, _SEALS, "\n\r" + sep)


def cells(line: Column, sep: str) -> Column:
    """Cells of one record of `sealed` content; quotes around a cell go, '""' in it is a quote."""
    plain = F.split(line, sep)
    return F.when(F.contains(line, F.lit('"')), F.transform(plain, lambda c: _bare(c, sep))).otherwise(plain)


def cell(row: Column, index: Column | int) -> Column:
    """Cell at a 0-based index, NULL beyond the end or for a negative index."""
    i = (F.lit(index) if isinstance(index, int) else index).cast("int")
    return F.when(i >= 0, F.try_element_at(row, i + 1))


def settled(files: DataFrame, **steps: Column) -> DataFrame:
    """Columns set one after the other as generated ones: what reads them below doesn't work them out again."""
    for name, c in steps.items():
        files = files.select(*[k for k in files.columns if k != name], F.explode(F.array(c)).alias(name))
    return files


def records(files: DataFrame, head: dict[str, Column], lines: Column, sep: str) -> DataFrame:
    """Pieces `c` of every record, whether it is `quoted`, and its place `pos` in `lines`, with what `head` takes from its file.

    The head of a file is generated as one row and a record's pieces as one value: else Spark works both out again for each record
    and each cell that is read. `record_cell` makes cells of pieces.
    """
    small_methods(files.sparkSession)  # parsers are long expressions
    f = files.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in head.items()]))).alias("_f"))
    f = f.select(*[F.col("_f")[n].alias(n) for n in head], F.posexplode(lines).alias("pos", "line"))
    f = f.select(*head, "pos", F.contains("line", F.lit('"')).alias("quoted"), F.posexplode(F.array(F.split("line", sep))).alias("_", "c"))
    return f.drop("_")


def record_cell(index: Column | int, sep: str) -> Column:
    """Cell of a row of `records` at a 0-based index; quotes are looked for only in records that have any."""
    piece = cell(F.col("c"), index)
    return F.when(F.col("quoted"), _bare(piece, sep)).otherwise(piece)


# ---- which broker (S2, S3) -------------------------------------------------------

BROKERS = ("degiro", "mbank", "bossa", "xtb")


def _has(text: Column, *words: str) -> Column:
    c = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        c = c & F.contains(text, F.lit(w))
    return c


def broker_of(content: Column) -> Column:
    """Broker by its characteristic header words, DEGIRO before mBank before Bossa; NULL if none fits."""
    first = F.lower(F.substring_index(content, "\n", 1))
    # a word that is nowhere is in no line either; small letters of a text are never fewer than its letters
    mbank = content.rlike("[cC][zZ][aA][sS]") & F.exists(
        F.split(F.lower(content), "\n"), lambda x: _has(x, "czas transakcji", "papier", "k/s") | _has(x, "czas", "walor", "rodzaj")
    ) | _has(F.substring(F.lower(F.substring(content, 1, 2001)), 1, 2000), "emakler", "historia transakcji")
    return (
        F.when(_has(first, "produkt", "isin", "kurs wymian"), "degiro")
        .when(mbank, "mbank")
        .when(_has(first, "data", "papier", "isin"), "bossa")
    )


def detect_broker(files: DataFrame, broker: str = "auto") -> DataFrame:
    """Files with their broker; a named broker overrides detection."""
    found = broker_of(F.col("content")) if broker == "auto" else F.lit(broker if broker in BROKERS else None)
    return files.withColumn("broker", found)


# ---- parsed rows ------------------------------------------------------------------

TRADE = ["file", "row", "date", "paper_name", "isin", "quantity", "side", "price", "value", "commission", "total", "currency", "source"]


def _settled(parsed: DataFrame) -> DataFrame:
    """Rows as one generated struct `r`: a filter on it is not pushed into the parsing, which would run twice."""
    return parsed.select(F.explode(F.array(F.struct("*"))).alias("r"))


def clean(parsed: DataFrame) -> DataFrame:
    """Accepted rows."""
    return _settled(parsed).filter(F.col("r.reason").isNull()).select("r.*").drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    """Refused rows with their number and reason."""
    return _settled(parsed).filter(F.col("r.reason").isNotNull()).select("r.file", "r.row", "r.reason", "r.paper_name")


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


__all__ = ["TRADE", "blank", "broker_of", "cell", "cells", "clean", "decode_broker_bytes", "detect_broker",
           "encode_1250", "filled_lines", "raw_lines", "read_broker_text", "record_cell", "records", "rejects", "sealed", "settled", "trimmed"]
