"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, no-break and other wide spaces and the byte order mark included.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
QUANTITY = "decimal(28,8)"
_SPACE = f"[{SPACES}]"


def trimmed(c: Column) -> Column:
    """Trim white space, no-break spaces included; NULL stays NULL."""
    return F.btrim(c, F.lit(SPACES))


def trimmed_cell(c: Column) -> Column:
    """`trimmed` of a column: text that begins and ends with a visible ASCII character is taken as it is."""
    last = F.substring(c, -1, 1)
    return F.when((c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f"), c).otherwise(trimmed(c))


def _odd_number(dense: Column) -> Column:
    """Text of the number that a text without spaces begins with."""
    comma = F.instr(dense, ",")
    dotted = F.when(comma > 0, F.overlay(dense, F.lit("."), comma, F.lit(1))).otherwise(dense)
    plain = F.translate(dotted, "0123456789", "").isin("", ".", "-", "-.")
    prefix = F.regexp_extract(dotted, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(plain, dotted).otherwise(prefix)


def polish_number(c: Column) -> Column:
    """E1: '1 234,56' -> 1234.56; the numeric prefix counts, anything else is 0."""
    bare = F.replace(F.replace(c, F.lit(" ")), F.lit("\u00a0"))  # the usual spaces; without a pattern
    usual = bare.rlike(r"\A-?[0-9]{1,15}(?:[.,][0-9]{1,15})?\z")
    # rare, and as a lambda one value: spelled out, it would repeat `c` some twenty times in the code of every number
    odd = F.element_at(F.transform(F.array(F.regexp_replace(c, f"{_SPACE}+", "")), _odd_number), 1)
    return F.coalesce(F.when(usual, F.replace(bare, F.lit(","), F.lit("."))).otherwise(odd).try_cast("double"), F.lit(0.0))


_WHOLE = 2.0**53  # doubles of this size and more are whole numbers


def floored(x: Column) -> Column:
    """floor() of a double as a double; the built-in one ends at the largest BIGINT."""
    return F.when(F.abs(x) < F.lit(_WHOLE), F.floor(x).cast("double")).otherwise(x)


def round_half_up(c: Column, digits: int = 2) -> Column:
    """floor(n * 10^d + 0.5) / 10^d on doubles."""
    scale = F.lit(float(10**digits))
    return floored(c * scale + F.lit(0.5)) / scale


def fixed(c: Column, scale: int = 6) -> Column:
    """One fixed-point term of `exact_sum`, for running sums; beyond 38 digits it raises."""
    x = c.cast("double") * F.lit(float(10**scale)) + F.lit(0.5)
    return F.when(F.abs(x) < F.lit(_WHOLE), F.floor(x).cast("decimal(38,0)")).otherwise(x.cast("decimal(38,0)"))


def exact_sum(c: Column, scale: int = 6) -> Column:
    """Sum of doubles in fixed point, so the result does not depend on shuffle order. Of values that are no finite number, their own sum."""
    c = c.cast("double")
    odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    total = F.sum(F.when(~odd, fixed(c, scale))).cast("double") / F.lit(float(10**scale))
    return F.coalesce(F.sum(F.when(odd, c)), total)


def unfixed(c: Column, scale: int = 6) -> Column:
    return c.cast("double") / F.lit(float(10**scale))


def num_or(c: Column, default) -> Column:
    """Numeric column: NULL and 0 give the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == 0), d).otherwise(c)


def text_or(c: Column, default) -> Column:
    """Text column: NULL and '' give the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == ""), d).otherwise(c)


def to_ts(text: Column) -> Column:
    """ISO text with or without a time part -> TIMESTAMP, NULL if it is neither."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    )


def dotted_date(c: Column, gap: str = r"\s*") -> Column:
    """DD.MM.YYYY[ HH:MM:SS] -> ISO text; other text passes through. gap: what may stand before the time."""
    whole = F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2), F.lit("T"), F.substring(c, 12, 8))
    iso = F.regexp_replace(c, rf"(?s)^.*?(\d{{2}})\.(\d{{2}})\.(\d{{4}})(?:{gap}(\d{{2}}:\d{{2}}:\d{{2}}))?.*$", "$3-$2-$1T$4")
    other = F.when((iso != c) & F.endswith(iso, F.lit("T")), F.concat(iso, F.lit("00:00:00"))).otherwise(iso)
    return F.when(c.rlike(r"\A\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}\z"), whole).otherwise(other)


def dashed_date(day: Column, time: Column) -> Column:
    """DD-MM-YYYY and HH:MM -> ISO text; other text passes through."""
    iso = F.regexp_replace(day, r"(?s)^.*?(\d{2})-(\d{2})-(\d{4}).*$", "$3-$2-$1T")
    clock = F.when(F.coalesce(time, F.lit("")) == "", F.lit("00:00:00")).otherwise(F.concat(time, F.lit(":00")))
    return F.when((iso != day) & F.endswith(iso, F.lit("T")), F.concat(iso, clock)).otherwise(day)


def serial_or_slashed_ts(c: Column) -> Column:
    """Spreadsheet serial (1000..100000, exclusive) or DD/MM/YYYY HH:MM:SS -> TIMESTAMP."""
    text = trimmed(c.cast("string"))
    number = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    millis = F.floor((number - F.lit(25569.0)) * F.lit(86400000.0))
    serial = F.timestamp_seconds(F.floor(millis / F.lit(1000.0)))
    slashed = r"^(\d{2})/(\d{2})/(\d{4})\s+(\d{2}:\d{2}:\d{2})$"
    iso = F.regexp_replace(text, slashed, "$3-$2-$1T$4")
    day, clock = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2)), F.substring(text, 12, 8)
    return (
        F.when(text.rlike(r"\A\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\z"), F.concat(day, F.lit("T"), clock).try_cast("timestamp"))
        .when((number > 1000) & (number < 100000), serial)
        .when(text.rlike(slashed), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    )


def compact_date(c: Column) -> Column:
    """YYYYMMDD -> DATE."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def operation_class(title: Column, amount: Column) -> Column:
    """Class of a cash operation by its title, first match wins; 'skip' = settlement."""
    return (
        F.when(title.contains("Rozliczenie transakcji"), "skip")
        .when(title.contains("Przelew") & (amount < 0), "withdrawal")
        .when(title.contains("Przelew"), "deposit")
        .when(F.lower(title).contains("dywidendy"), "dividend")
        .when(title.contains("Wymiana waluty"), "fx_exchange")
        .when(title.contains("Opłata za transakcj"), "fee")
        .when(title.contains("Zwrot prowizji"), "commission_refund")
        .otherwise("other")
    )


def dividend_ticker(title: Column) -> Column:
    """E5: ticker named in a dividend title, NULL if there is none."""
    return F.nullif(F.regexp_extract(title, rf"(?i)dywidendy(?:[{SPACES}]+netto)?[{SPACES}]+(\w+)", 1), F.lit(""))


_FX_TITLE = r"Wymiana waluty (\w+/\w+) ([\d.]+)"


def fx_pair(title: Column) -> Column:
    """E6: 'PLN/USD' of 'Wymiana waluty PLN/USD 3.5713'."""
    return F.nullif(F.regexp_extract(title, _FX_TITLE, 1), F.lit(""))


def fx_rate(title: Column) -> Column:
    prefix = F.regexp_extract(F.regexp_extract(title, _FX_TITLE, 2), r"^(\d+\.?\d*|\.\d+)", 1)
    return prefix.try_cast("double")


def is_isin(c: Column) -> Column:
    """Two letters and ten letters or digits."""
    return c.rlike("^[A-Z]{2}[A-Z0-9]{10}$")


def clean_paper_name(c: Column) -> Column:
    """Drop the market suffixes -NC, -NC-FIX and -C."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)-NC(?:-FIX)?$", ""), r"(?i)-C$", ""))


def currency_code(c: Column) -> Column:
    """Upper case, trimmed; EUR if empty. Pence (GBX) stay pence."""
    return text_or(trimmed(F.upper(F.coalesce(c, F.lit("")))), "EUR")


def day(c: Column) -> Column:
    return F.to_date(c)
