"""Instrument lookup, enrichment and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clean_paper_name, is_isin, num_or, text_or
from ..tables import pinned

# Former trading name -> ISIN.
NAME_ALIASES = {
    "ONCOARENDI": "PLONCTH00011",
    "LIVECHAT": "PLLVTSF00010",
    "LIVECHATSOFTWARE": "PLLVTSF00010",
    "R22": "PLR220000018",
    "R22.WA": "PLR220000018",
    "BRU": "PLMOBRK00013",
    "BRU.WA": "PLMOBRK00013",
}

# Former or ambiguous Polish symbol -> current symbol.
SYMBOL_ALIASES = {
    "DINO": "DNP", "R22": "CBF", "BRU": "MBR", "CCC": "MOD", "RAEN": "GVT", "NEPTS": "YAN", "VGN": "TEC", "EON": "EUV",
    "DTL": "VAI", "PKN": "ORL", "LVC": "TXT", "FMF": "GNE", "GBK": "CPT", "OAT": "MOC", "4FM": "DIG", "WSC": "GGP",
    "LCC": "DVL", "VST": "VRG", "PIL": "DAT", "RAE": "GVT", "VAK": "BTF", "SUN": "MIG", "PGM": "GNS", "PUN": "RAE",
    "BRZ": "HUB", "MCP": "BEL", "IQP": "PUN", "7FT": "OML", "BSP": "IVO", "ZAK": "PDG", "SKN": "SIM", "BLU": "CLC",
}

# Country suffix of a broker symbol -> suffix of the market symbol, currency.
SYMBOL_SUFFIXES = {
    "PL": (".WA", "PLN"), "US": ("", "USD"), "NL": (".AS", "EUR"), "DE": (".DE", "EUR"), "UK": (".L", "GBP"),
    "FR": (".PA", "EUR"), "ES": (".MC", "EUR"), "IT": (".MI", "EUR"), "SE": (".ST", "SEK"), "NO": (".OL", "NOK"),
    "DK": (".CO", "DKK"), "CH": (".SW", "CHF"), "HK": (".HK", "HKD"),
}

# Symbols with another name at the Polish price source, and one it must not be asked for.
PROVIDER_ALIASES = {"big": "bcs", "cyb": "cbf"}
PROVIDER_BLACKLIST = ["wod"]

# PLN rates used where none is known.
DEFAULT_RATES = {"USD": 4.0, "CAD": 2.95, "EUR": 4.3, "PLN": 1.0}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small fixed mapping, NULL if the key is not in it."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


# ---- scans and search (F7-F10) --------------------------------------------------


def by_name(instruments: DataFrame) -> DataFrame:
    """ordered by name."""
    return instruments.orderBy("name")


def by_symbol(instruments: DataFrame, symbol: str) -> DataFrame:
    """exact symbol."""
    return instruments.filter(F.col("ticker") == symbol)


def instrument_search(instruments: DataFrame, text: str) -> DataFrame:
    """F8: case-insensitive part of ticker, name or ISIN."""
    part = F.lit(text.lower())
    return instruments.filter(
        F.lower("ticker").contains(part) | F.lower("name").contains(part) | F.lower("isin").contains(part)
    ).select(F.col("ticker").alias("symbol"), "name", "exchange", "currency")


def instrument_searches(instruments: DataFrame, texts: DataFrame) -> DataFrame:
    """F8 for a table of search texts (`query`): every instrument whose ticker, name or ISIN contains the text, in any case.

    An equi-join on parts of the lengths that the texts have, as in `containing`.
    """
    asked = texts.select("query", F.lower("query").alias("_part")).filter(F.length("query") > 0).distinct()
    lengths = asked.agg(F.collect_set(F.length("_part")).alias("_lengths")).withColumn("_one", F.lit(1))  # one row
    fields = F.flatten(F.array(*[_parts(F.lower(F.coalesce(c, F.lit(""))), F.col("_lengths")) for c in ("ticker", "name", "isin")]))
    cut = instruments.withColumn("_one", F.lit(1)).join(F.broadcast(lengths), "_one").select(
        F.col("ticker").alias("symbol"), "name", "exchange", "currency", F.explode(F.array_distinct(fields)).alias("_part"))
    return asked.join(cut, "_part").select("query", "symbol", "name", "exchange", "currency")


def equity_hits(raw: DataFrame) -> DataFrame:
    """equity and ETF hits of a search answer, best name and exchange."""
    wanted = F.col("type_disp").isin("Equity", "ETF") | F.col("quote_type").isin("EQUITY", "ETF")
    return raw.filter(F.coalesce(wanted, F.lit(False))).select(
        "symbol",
        text_or(text_or(F.col("long_name"), F.col("short_name")), F.col("symbol")).alias("name"),
        text_or(text_or(F.col("exch_disp"), F.col("exchange")), "UNKNOWN").alias("exchange"),
        F.lit(None).cast("string").alias("currency"),
    )


def search_merge(local: DataFrame, polish: DataFrame, world: DataFrame, n: int = 15) -> DataFrame:
    """first n symbols of three answers, in that order of trust; upper-case duplicates drop out.

    Within an answer its own order counts (column `pos`, where there is one), then name and symbol; hits alike in these, exchange and
    currency. With a column `query`, for each search text.
    """
    cols = ["symbol", "name", "exchange", "currency"]
    on = [c for c in ("query",) if c in local.columns]
    place = lambda d: F.col("pos").cast("long") if "pos" in d.columns else F.lit(0).cast("long")
    parts = [d.select(*on, *cols, F.lit(i).alias("rank"), place(d).alias("pos")) for i, d in enumerate((local, polish, world))]
    best = reduce(DataFrame.unionByName, parts).groupBy(*on, F.upper("symbol").alias("key")).agg(
        F.min_by(F.struct(*cols, "rank", "pos"), F.struct("rank", "pos", "name", "symbol", "exchange", "currency")).alias("hit"))
    hit = best.select(*on, "hit.*")
    if not on:
        return hit.orderBy("rank", "pos", "name", "symbol").limit(n).drop("pos")
    first = F.row_number().over(W.partitionBy(*on).orderBy("rank", "pos", "name", "symbol"))
    return hit.withColumn("_n", first).filter(F.col("_n") <= n).drop("_n", "pos")


# ---- enrichment (J1, J3-J6) ------------------------------------------------------


def map_keys(instruments: DataFrame) -> list[str]:
    """Instrument maps are per portfolio, or shared if they carry no portfolio."""
    return [c for c in ("portfolio_id", "isin") if c in instruments.columns]


def enrich_transactions(tx: DataFrame, instruments: DataFrame) -> DataFrame:
    """Transactions with ticker, name and exchange of their instrument."""
    on = map_keys(instruments)
    joined = tx.join(instruments.select(*on, "ticker", "name", "exchange"), on, "left")
    return joined.withColumns({
        "ticker": text_or(F.col("ticker"), F.col("isin")),
        "name": text_or(F.col("name"), F.col("paper_name")),
        "exchange": F.coalesce("exchange", F.lit("")),
    })


def polish_source(source: Column, ticker: Column) -> Column:
    return (source == "stooq") | F.endswith(ticker, F.lit(".WA"))


def quotes_selected(instruments: DataFrame, quotes: DataFrame) -> DataFrame:
    """The quote of each instrument from the source it is priced by; `quotes` has (ticker, source)."""
    source = quote_source(F.col("price_source"), F.col("ticker"))
    wanted = instruments.select("ticker", source.alias("source")).distinct()
    return wanted.join(quotes, ["ticker", "source"], "left").select("ticker", "source", "price", "previous_close")


def latest_rates(prices: DataFrame) -> DataFrame:
    """Latest PLN rate per currency from the rate series <CUR>PLN=X."""
    code = F.regexp_extract("ticker", r"^([A-Z]{3})PLN=X$", 1)
    return (
        prices.filter(F.col("ticker").endswith("PLN=X")).groupBy(code.alias("currency"))
        .agg(F.max_by("close", "date").alias("rate"))
    )


def rate_or_default(currency: Column, rate: Column) -> Column:
    """Known rate, else the default of the currency, else 1. PLN is always 1."""
    default = F.coalesce(lookup_rate(currency), F.lit(1.0))
    supported = currency.isin("USD", "CAD", "EUR")
    return F.when(currency == "PLN", F.lit(1.0)).when(supported, num_or(rate, default)).otherwise(F.lit(1.0))


def lookup_rate(currency: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DEFAULT_RATES.items() for x in pair])
    return F.try_element_at(table, currency)


def with_rates(df: DataFrame, rates: DataFrame, currency: str = "currency", name: str = "fx") -> DataFrame:
    """PLN rate of each row's currency."""
    r = rates.select(F.col("currency").alias("_cur"), F.col("rate").alias("_rate"))
    return df.join(r, F.col(currency) == F.col("_cur"), "left").withColumn(
        name, rate_or_default(F.col(currency), F.col("_rate"))).drop("_cur", "_rate")


def choose_price_source(instruments: DataFrame, prices: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Source whose history prices a ticker. Fewer than 10 Polish points give way to a longer global series.

    Per portfolio if instruments have one; with `starts` (portfolio_id, start) points count from the portfolio's start on.
    A ticker of several papers is Polish if one of them says so.
    """
    zero = F.lit(0).cast("long")
    on = [c for c in ("portfolio_id", "ticker") if c in instruments.columns]
    polish = polish_source(F.col("price_source"), F.col("ticker"))
    t = instruments.groupBy(*on).agg(F.coalesce(F.bool_or(polish), F.lit(False)).alias("is_polish"))
    counts = [F.count_if(F.col("source") == s).alias(n) for s, n in (("stooq", "polish"), ("yahoo", "world"))]
    if starts is None:
        j = t.join(prices.groupBy("ticker").agg(*counts), "ticker", "left")
    else:
        t = t.join(starts.select("portfolio_id", "start"), "portfolio_id")
        # counts from a day on, for the distinct days that are asked for: at most one row a calendar day and ticker
        days = prices.groupBy("ticker", "date").agg(*counts).select("ticker", "date", "polish", "world", F.lit(None).cast("date").alias("start"))
        asked = t.select("ticker", "start").distinct().select("ticker", F.col("start").alias("date"), zero.alias("polish"), zero.alias("world"), "start")
        since = W.partitionBy("ticker").orderBy(F.desc("date")).rangeBetween(W.unboundedPreceding, W.currentRow)
        later = days.unionByName(asked).select("ticker", "start", *(F.sum(c).over(since).alias(c) for c in ("polish", "world"))).filter("start IS NOT NULL")
        j = t.join(later, ["ticker", "start"], "left")
    j = j.select(*on, "is_polish", F.coalesce("polish", zero).alias("polish"), F.coalesce("world", zero).alias("world"))
    keep = F.col("is_polish") & ~((F.col("polish") < 10) & (F.col("world") > F.col("polish")))
    return j.select(*on, "polish", "world", F.when(keep, "stooq").otherwise("yahoo").alias("source"))


def chosen_prices(instruments: DataFrame, prices: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The price rows of each ticker's chosen source; with the portfolio that chose it, if choices are per portfolio."""
    choice = choose_price_source(instruments, prices, starts).drop("polish", "world")
    return choice.join(prices, ["ticker", "source"])


def quote_source(source: Column, ticker: Column) -> Column:
    """The source an instrument is quoted from."""
    return F.when(polish_source(source, ticker), "stooq").otherwise("yahoo")


def unknown_instruments(tx: DataFrame, instruments: DataFrame) -> DataFrame:
    """ISINs that are not mapped, with name and currency of their first trade."""
    on = map_keys(instruments)
    first = F.struct("ts", *[c for c in ("portfolio_id", "id") if c in tx.columns])
    return tx.join(instruments.select(*on), on, "left_anti").groupBy(*on).agg(
        F.min_by("paper_name", first).alias("paper_name"), F.min_by("currency", first).alias("currency"))


# ---- name to ISIN (J7) -------------------------------------------------------------

def _parts(text: Column, lengths: Column) -> Column:
    """All distinct parts of a text that have one of the lengths."""
    n = F.length(text)
    fitting = F.filter(lengths, lambda k: (k > 0) & (k <= n))
    return F.array_distinct(F.flatten(F.transform(fitting, lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda s: F.substr(text, s, k)))))


def containing(needles: DataFrame, hay: DataFrame, on: list[str], needle: str, text: str, best: Column | dict[str, Column]) -> DataFrame:
    """For each needle the best (lowest `best`) row of `hay` whose `text` contains it, as struct `hit`; several orders by name.

    An equi-join on whole needles: the texts are cut into parts of the lengths that needles have, and of equal parts only the
    best row is kept before the join, so names that begin alike do not meet.
    """
    orders = best if isinstance(best, dict) else {"hit": best}
    asked = needles.filter(F.length(needle) > 0)
    lengths = asked.agg(F.collect_set(F.length(needle)).alias("_lengths")).withColumn("_one", F.lit(1))  # one row, no more than the longest needle
    rows = [F.struct(c.alias("rank"), *[x for x in hay.columns if x not in on]).alias(n) for n, c in orders.items()]
    cut = hay.withColumn("_one", F.lit(1)).join(F.broadcast(lengths), "_one").select(
        *on, *rows, F.explode(_parts(F.col(text), F.col("_lengths"))).alias(needle))
    found = cut.groupBy(*on, needle).agg(*[F.min(n).alias(n) for n in orders])
    return asked.distinct().join(found, [*on, needle]).select(*needles.columns, *orders)


def name_to_isin(names: DataFrame, instruments: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Mapped ISIN of each paper name: alias, exact name, symbol before a dot, part of a name.

    Of several hits on one rung the lowest ISIN counts.
    """
    on = [c for c in ("portfolio_id",) if c in instruments.columns]
    inst = instruments.select(*on, "isin", F.upper("ticker").alias("symbol"), F.upper("name").alias("title"))
    asked = names.select(*on, "paper_name").distinct().withColumn("needle", clean_paper_name(F.upper("paper_name")))
    keys = [*on, "paper_name", "needle"]
    known = inst.select(*on, "isin")
    table = NAME_ALIASES if aliases is None else aliases
    alias = asked.withColumn("isin", lookup(table, F.col("needle"))).filter(F.col("isin").isNotNull())
    by_alias = alias.join(known, [*on, "isin"], "left_semi").select(*keys, "isin", F.lit(1).alias("rung"))
    titled = inst.select(*on, F.col("title").alias("needle"), "isin")
    exact = asked.join(titled, [*on, "needle"]).select(*keys, "isin", F.lit(2).alias("rung"))
    dots = F.split("symbol", r"\.")
    heads = F.when(F.size(dots) > 1, F.transform(
        F.sequence(F.lit(1), F.size(dots) - 1), lambda i: F.array_join(F.slice(dots, 1, i), ".")))
    symbols = inst.select(*on, "isin", F.explode(heads).alias("needle"))
    head = asked.join(symbols, [*on, "needle"]).select(*keys, "isin", F.lit(3).alias("rung"))
    sure = by_alias.unionByName(exact).unionByName(head)
    rest = asked.join(sure.select(*on, "paper_name"), [*on, "paper_name"], "left_anti")
    part = containing(rest, inst.select(*on, "isin", "title"), on, "needle", "title", F.col("isin"))
    part = part.select(*keys, F.col("hit.isin").alias("isin"), F.lit(4).alias("rung"))
    return sure.unionByName(part).groupBy(*on, "paper_name").agg(F.min(F.struct("rung", "isin")).alias("best")).select(
        *on, "paper_name", F.col("best.isin").alias("isin"), F.col("best.rung").alias("rung"))


def with_resolved_isins(tx: DataFrame, instruments: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """J7 on an import: trades take the ISIN their paper name maps to."""
    on = [c for c in ("portfolio_id",) if c in instruments.columns]
    # names and what they map to are written out: the rungs read the names many times, and a small table's size is known to the join
    names = pinned(tx.select(*on, "paper_name").distinct(), "paper-names")
    found = pinned(name_to_isin(names, instruments, aliases).select(*on, "paper_name", F.col("isin").alias("_isin")), "paper-isins")
    return tx.join(found, [*on, "paper_name"], "left").withColumn("isin", F.coalesce("_isin", "isin")).drop("_isin")


# ---- resolution against a catalogue (J8-J11) ------------------------------------------


def name_agrees(a: Column, b: Column) -> Column:
    """Equal, or both at least 4 long with the same first 4 characters."""
    shortest = F.least(F.length(a), F.length(b))
    return (a == b) | ((shortest >= 4) & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))))


def split_etf_name(c: Column) -> Column:
    """J10: 'BETAETFWIG20TR' -> 'BETA ETF WIG20TR'; other names pass through."""
    up = F.upper(c)
    pattern = r"^(BETA|XTRACKERS?|ISHARES?|LYXOR|AMUNDI)?(ETF)(.+)$"
    words = F.concat_ws(" ", *[F.nullif(F.regexp_extract(up, pattern, i), F.lit("")) for i in (1, 2, 3)])
    return F.when(up.rlike(pattern), words).otherwise(c)


def infer_exchange(ticker: Column, code: Column) -> Column:
    """Exchange from the symbol suffix, else from the provider's exchange code."""
    up = F.upper(F.coalesce(code, F.lit("")))
    return (
        F.when(F.endswith(ticker, F.lit(".WA")), "GPW")
        .when(F.endswith(ticker, F.lit(".DE")), "XETRA")
        .when(F.endswith(ticker, F.lit(".TO")), "TSX")
        .when(up.contains("NASDAQ") | up.isin("NMS", "NGM", "NCM"), "NASDAQ")
        .when(up.contains("NYSE") | (up == "NYQ"), "NYSE")
        .when(up.contains("XETRA") | (up == "GER"), "XETRA")
        .when(up.contains("TSX") | (up == "TOR"), "TSX")
        .when(up.contains("WARSAW") | up.contains("WSE"), "GPW")
        .otherwise("OTHER")
    )


def infer_source(ticker: Column) -> Column:
    """Price source of a symbol."""
    return F.when(F.endswith(ticker, F.lit(".WA")), "stooq").otherwise("yahoo")


def infer_currency(ticker: Column, quoted: Column, traded: Column) -> Column:
    """PLN in Warsaw, else the quote's currency, else the trade's."""
    return F.when(F.endswith(ticker, F.lit(".WA")), F.lit("PLN")).otherwise(text_or(quoted, traded))


def resolve_instruments(unknown: DataFrame, catalogue: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Instrument of each unknown ISIN from a catalogue, in place of provider look-ups.

    catalogue: market ('polish' or 'world'), symbol, name, isin, exchange, currency, pos (order of
    the provider's answer). Polish pseudo ISINs (broker names) try the Polish market first, by
    symbol (alias, first 4, first 3 characters) and name, then the world by ISIN and name; all
    others try the world by ISIN and name, real Polish ISINs then Polish symbols that agree in name.
    """
    on = [c for c in ("portfolio_id", "isin") if c in unknown.columns]
    real = is_isin(F.col("isin"))
    polish = (real & F.col("isin").startswith("PL")) | F.endswith("isin", F.lit(".WA")) | (~real & (F.col("currency") == "PLN"))
    name = F.trim(F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.col("paper_name"), r"(?i)-NC(?:-FIX)?$", ""), r"(?i)-C$", ""), r"(?i)\.WA$", ""))
    u = unknown.select(*on, "paper_name", "currency", real.alias("real"), polish.alias("polish"), name.alias("clean"))
    u = u.withColumn("first", F.col("polish") & ~F.col("real") & (F.length("clean") >= 2))
    pol = catalogue.filter(F.col("market") == "polish")
    world = catalogue.filter(F.col("market") == "world")

    # symbols of the Polish market
    table = SYMBOL_ALIASES if aliases is None else aliases
    stem = F.when(F.col("first"), F.coalesce(lookup(table, F.upper("clean")), F.col("clean"))).otherwise(F.col("clean"))
    s = u.filter(F.col("polish") & (F.length("clean") >= 2)).withColumn("stem", stem)
    fund = F.upper("stem").startswith("ETF") | F.upper("stem").startswith("BETA")
    tries = F.array(
        F.struct(F.lit(1).alias("n"), F.col("stem").alias("try")),
        F.struct(F.lit(2).alias("n"), F.when(~fund & (F.length("stem") > 4), F.left("stem", F.lit(4))).alias("try")),
        F.struct(F.lit(3).alias("n"), F.when(~fund & (F.length("stem") > 3), F.left("stem", F.lit(3))).alias("try")),
    )
    s = s.select("*", F.explode(tries).alias("t")).select("*", "t.n", F.col("t.try").alias("try")).drop("t", "stem")
    raw = F.lower(F.regexp_replace("try", r"^(.*?)\.WA", "$1"))
    s = s.withColumn("key", raw).filter((F.length("key") <= 20) & ~F.col("key").contains(".") & ~F.col("key").contains(" "))
    listed = pol.select(F.lower(F.regexp_replace("symbol", r"^(.*?)\.WA", "$1")).alias("key"), F.upper(F.trim("name")).alias("title"), "pos")
    listed = listed.groupBy("key").agg(F.min_by("title", "pos").alias("title"))
    hit = s.join(listed, "key")
    agrees = F.col("first") | (F.coalesce("title", F.lit("")) == "") | name_agrees(F.col("title"), F.upper("clean"))
    title = text_or(F.col("title"), F.upper("key"))
    by_sym = hit.filter(agrees).select(
        *on, F.when(F.col("first"), 10 + F.col("n")).otherwise(50 + F.col("n")).alias("step"),
        F.concat(F.upper("key"), F.lit(".WA")).alias("ticker"),
        F.when(title != F.upper("try"), title).otherwise(F.col("paper_name")).alias("name"),
        F.lit("GPW").alias("exchange"), F.lit("PLN").alias("res_currency"), F.lit("stooq").alias("price_source"))

    # names of the Polish market
    squeezed = u.filter(F.col("first") & (F.length("clean") >= 3)).withColumn(
        "needle", F.lower(F.regexp_replace("clean", r"\s+", "")))
    shop = pol.filter(~F.col("symbol").contains("_") & ~F.regexp_replace("symbol", r"\.WA$", "").contains(".")).select(
        "pos", F.regexp_replace("symbol", r"\.WA$", "").alias("symbol"), "name", "exchange",
        F.lower(F.regexp_replace("name", r"\s+", "")).alias("title"))
    named = containing(squeezed.select("needle").distinct(), shop, [], "needle", "title", F.col("pos"))
    by_pol_name = squeezed.join(named, "needle").select(
        *on, F.lit(20).alias("step"), F.concat(F.upper("hit.symbol"), F.lit(".WA")).alias("ticker"),
        text_or(F.col("hit.name"), F.col("hit.symbol")).alias("name"),
        F.when(F.col("hit.exchange").isin("NC", "XNCO"), "NC").otherwise("GPW").alias("exchange"),
        F.lit("PLN").alias("res_currency"), F.lit("stooq").alias("price_source"))

    def world_entry(h: DataFrame, step: Column) -> DataFrame:
        t = F.col("hit.symbol")
        return h.select(
            *on, step.alias("step"), t.alias("ticker"), text_or(F.col("hit.name"), F.col("paper_name")).alias("name"),
            infer_exchange(t, F.col("hit.exchange")).alias("exchange"),
            infer_currency(t, F.col("hit.currency"), F.col("currency")).alias("res_currency"),
            infer_source(t).alias("price_source"))

    w = world.select("isin", "symbol", "name", "exchange", "currency", "pos")
    row = F.struct("pos", "symbol", "name", "exchange", "currency")
    wa_first = F.struct(~F.endswith("symbol", F.lit(".WA")), "pos")
    per_isin = w.groupBy("isin").agg(F.min_by(row, "pos").alias("any"), F.min_by(row, wa_first).alias("wa"))
    by_isin = u.join(per_isin, "isin").withColumn("hit", F.when(F.col("polish"), F.col("wa")).otherwise(F.col("any")))
    by_world_isin = world_entry(by_isin, F.lit(30))

    variants = F.array_distinct(F.array(F.col("clean"), F.when(~F.col("real"), split_etf_name(F.col("clean"))).otherwise(F.col("clean"))))
    v = u.filter((F.length("clean") >= 2) & (~F.col("first") | (F.col("clean") != F.col("isin"))))
    v = v.select("*", F.posexplode(F.when(F.col("first"), F.array("clean")).otherwise(variants)).alias("vn", "variant"))
    v = v.withColumn("needle", F.upper("variant"))
    titles = w.select("pos", "symbol", "name", "exchange", "currency", F.upper("name").alias("title"))
    asked = v.select("needle").distinct()
    both = containing(asked, titles, [], "needle", "title", {
        "any_hit": F.struct(F.lit(False), "pos"), "wa_hit": F.struct(~F.endswith("symbol", F.lit(".WA")), "pos")})
    by_name_ = v.join(both, "needle").withColumn(
        "hit", F.when(F.col("first"), F.struct(*[F.col(f"wa_hit.{c}").alias(c) for c in ("symbol", "name", "exchange", "currency")]))
        .otherwise(F.struct(*[F.col(f"any_hit.{c}").alias(c) for c in ("symbol", "name", "exchange", "currency")])))
    by_world_name = world_entry(by_name_, F.lit(40) + F.col("vn"))

    steps = reduce(DataFrame.unionByName, [by_sym, by_pol_name, by_world_isin, by_world_name])
    fields = ["step", "ticker", "name", "exchange", "res_currency", "price_source"]
    best = steps.groupBy(*on).agg(F.min_by(F.struct(*fields), "step").alias("r"))
    return unknown.select(*on, "paper_name", F.col("currency").alias("trade_currency")).join(best, on, "left").select(
        *on, "paper_name", "trade_currency", F.col("r.ticker").alias("ticker"), F.col("r.name").alias("name"),
        F.col("r.exchange").alias("exchange"), F.col("r.res_currency").alias("currency"),
        F.col("r.price_source").alias("price_source"), F.coalesce("r.step", F.lit(0)).alias("step"),
        F.col("r").isNotNull().alias("resolved"))


# ---- symbols of brokers and providers (J12, J13) -----------------------------------------


def broker_symbol(symbol: Column) -> tuple[Column, Column]:
    """Market symbol and currency of a broker symbol; a company name stays itself, in PLN."""
    coded = symbol.rlike(r"\.\w{2}$")
    suffix = F.upper(F.substring_index(symbol, ".", -1))
    stem = F.regexp_replace(symbol, r"\.[^.]*$", "")
    market = F.coalesce(lookup({k: v[0] for k, v in SYMBOL_SUFFIXES.items()}, suffix), F.lit(""))
    currency = F.coalesce(lookup({k: v[1] for k, v in SYMBOL_SUFFIXES.items()}, suffix), F.lit("USD"))
    return F.when(coded, F.concat(stem, market)).otherwise(symbol), F.when(coded, currency).otherwise("PLN")


def provider_symbol(ticker: Column) -> Column:
    """Symbol at the Polish price source, NULL if it must not be asked for."""
    raw = F.lower(F.regexp_replace(ticker, r"^(.*?)\.WA", "$1"))
    return F.when(~raw.isin(*PROVIDER_BLACKLIST), F.coalesce(lookup(PROVIDER_ALIASES, raw), raw))
