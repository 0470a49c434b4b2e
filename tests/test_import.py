from datetime import datetime

from pyspark.sql import functions as F

from folio.functions import exprs as x
from folio.sources import brokers, providers, text, xtb


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, content string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_polish_numbers(spark):
    for text_, want in [("1 234,56", 1234.56), ("1 234,5", 1234.5), ("-3,5x", -3.5), ("", 0.0), (None, 0.0), ("abc", 0.0), ("1,2,3", 1.2), ("12.5", 12.5)]:
        assert one(spark, x.polish_number, text_) == want


def test_rounding_and_dates(spark):
    assert spark.range(1).select(x.round_half_up(F.lit(2.675))).first()[0] == 2.68
    assert one(spark, x.dotted_date, "25.02.2026 09:47:27") == "2026-02-25T09:47:27"
    assert one(spark, x.dotted_date, "25.02.2026") == "2026-02-25T00:00:00"
    assert one(spark, x.serial_or_slashed_ts, "43769.5") == datetime(2019, 10, 31, 12)
    assert one(spark, x.serial_or_slashed_ts, "31/10/2019 12:00:01") == datetime(2019, 10, 31, 12, 0, 1)
    assert one(spark, x.serial_or_slashed_ts, "12") is None


def test_titles(spark):
    assert one(spark, x.dividend_ticker, "Wypłata dywidendy netto NVO 73% PLN") == "NVO"
    assert one(spark, x.dividend_ticker, "Wypłata dywidendy PLAYWAY") == "PLAYWAY"
    assert one(spark, x.fx_rate, "Wymiana waluty PLN/USD 3.5713") == 3.5713


def test_read_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("papier;Wypłata żółć".encode("cp1250"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + "papier;Wypłata żółć".encode())
    got = text.read_broker_text(spark, str(tmp_path)).select(x.trimmed(F.col("content"))).collect()
    assert {r[0] for r in got} == {"papier;Wypłata żółć"}


BOSSA = ("data;papier;isin;ilość;-;cena;wartość;prowizja;po prowizji;waluta\r\n25.02.2026 09:47:27;PLAYWAY;PLR220000018;1 000;K;1 234,56;10;0,5;11;PLN\r\n\r\n"
         ";A;PL1;1;K;1;1;1;1;PLN\n25.02.2026;A;;1;K;1;1;1;1;PLN\n25.02.2026;A;PL1;1;Z;1;1;1;1;PLN\n25.02.2026;A;PL1;0;K;1;1;1;1;PLN")


def test_bossa(spark):
    p = brokers.bossa_transactions(files(spark, BOSSA, "x;y\n1;2"))
    ok = text.clean(p).collect()
    assert [(r.row, r.date, r.quantity, r.price, r.total) for r in ok] == [(2, "2026-02-25T09:47:27", 1000, 1234.56, 11.0)]
    bad = text.rejects(p).orderBy("row").collect()
    assert [(r.row, r.reason) for r in bad] == [(3, "missing_date"), (4, "missing_isin"), (5, "invalid_side"), (6, "invalid_quantity")]


def test_mbank_finds_header(spark):
    head = "Czas transakcji;Papier;Giełda;K/S;Liczba;Kurs;Waluta;Prowizja;Waluta;Wartość;Waluta"
    moved = "Papier;Czas transakcji;Giełda;K/S;Kurs;Waluta;Liczba;Prowizja;Waluta"
    p = brokers.mbank_transactions(files(
        spark, f"mBank\nx;y\n{head}\n01.02.2024 10:00:00;CDR;WWA;K;10;99,50;USD;1,00;PLN;995;PLN\nshort;row",
        f"{moved}\nCDR;01.02.2024;WWA;S;2,5;EUR;4;0,1;PLN"))
    ok = {r.file: r for r in text.clean(p).collect()}
    assert (ok["f0"].row, ok["f0"].value, ok["f0"].total, ok["f0"].currency, ok["f0"].isin) == (4, 995.0, 996.0, "USD", "CDR")
    assert (ok["f1"].price, ok["f1"].quantity, ok["f1"].currency, ok["f1"].total) == (2.5, 4, "EUR", 9.9)
    assert [(r.row, r.reason) for r in text.rejects(p).collect()] == [(5, "short_row")]


def test_degiro(spark):
    head = "Data,Czas,Produkt,ISIN,G,M,Liczba,Kurs,,Wartość lokalna,,Wartość,,Kurs wymian,Opłata,,Razem,,Id"
    row = lambda q, p, v: f'01-02-2024,09:30,"Acme, Inc",US0000000001,NDQ,X,{q},{p},GBX,{v},GBX,1,EUR,,-2.50,EUR,1,EUR,o1'
    f = files(spark, "\n".join([head, row(-5, "10.5", "52.5"), row(5, "0", "52.5"), "a,b,c"]))
    p = brokers.degiro_transactions(f)
    r = text.clean(p).first()
    assert (r.side, r.quantity, r.price, r.commission, r.total, r.currency, r.paper_name, r.date) == (
        "S", 5, 10.5, 2.5, 50.0, "GBX", "Acme, Inc", "2024-02-01T09:30:00")
    assert {(r.row, r.reason) for r in text.rejects(p).collect()} == {(3, "corporate_action"), (4, "short_row")}
    assert text.detect_broker(f).first().broker == "degiro"
    assert text.detect_broker(f, "mbank").first().broker == "mbank"


def test_xtb(spark):
    sheet = "\n".join([
        "CASH OPERATION HISTORY", "Currency,EUR", "ID,Type,Time,Comment,Symbol,Amount",
        "1,Stock purchase,01/02/2024 10:00:00,OPEN BUY 33/60 @ 35.560,JSW.PL,-1173.48",
        "2,commission,01/02/2024 10:00:00,x,JSW.PL,-1.5",
        "3,Stock purchase,02/02/2024 10:00:00,Order #1 cash stock purchase,PLTR.US,-1",
        "4,commission,02/02/2024 10:00:00,BUY 80 @ 19.32,PLTR.US,-2",
        "5,Stock sale,03/02/2024 10:00:00,Return position,PLTR.US,1545.6",
        "6,close trade,03/02/2024 10:00:00,profit,PLTR.US,54.4",
        "7,Sec Fee,04/02/2024 10:00:00,Sec Fee adj PLTR.US 20240203,PLTR.US,-0.25",
        "8,commission,05/02/2024 10:00:00,x,NONE.US,-3", "9,deposit,45322.5,in,,100", "10,withdrawal,05/02/2024 10:00:00,out,,50",
        "11,deposit,never,in,,1", "Total,,,,,"])
    trades, ops, bad, bad_ops = xtb.xtb_import(files(spark, sheet))
    got = {r.row: (r.isin, float(r.quantity), r.side, r.price, r.commission, r.total, r.currency) for r in trades.collect()}
    assert got == {
        4: ("JSW.WA", 33.0, "K", 35.56, 1.5, 1174.98, "PLN"), 6: ("PLTR", 80.0, "K", 19.32, 2.0, 1547.6, "USD"),
        8: ("PLTR", 80.0, "S", 20.0, 0.25, 1599.75, "USD")}
    assert {(r.row, r.operation_type, r.amount, r.currency, r.ticker) for r in ops.collect()} == {
        (11, "fee", -3.0, "EUR", "NONE"), (12, "deposit", 100.0, "EUR", None), (13, "withdrawal", -50.0, "EUR", None)}
    assert [(r.row, r.reason) for r in bad.collect()] == [(9, "close_trade_entry")]
    assert [(r.row, r.reason) for r in bad_ops.collect()] == [(14, "invalid_date")]


def test_provider_payloads(spark):
    doc = '{"chart":{"result":[{"meta":{"regularMarketPrice":5.5,"previousClose":5.0},"timestamp":[1704207600,1704294000],"indicators":{"quote":[{"close":[1.5,null]}]}}]}}'
    p = spark.createDataFrame([("T", doc), ("N", '{"chart":{"result":null}}')], "ticker string, payload string")
    assert [(r.ticker, str(r.date), r.close) for r in providers.flatten_chart_json(p).collect()] == [("T", "2024-01-02", 1.5)]
    assert [tuple(r) for r in providers.flatten_quote_json(p).collect()] == [("T", 5.5, "USD", 5.0)]
    c = spark.createDataFrame([("A", "Data,Otwarcie,Zamknięcie\n2024-01-02,1,2.5\n2024-01-03,1,N/D"), ("B", "Przekroczony dzienny limit")], "ticker string, payload string")
    assert [(r.ticker, str(r.date), r.close) for r in providers.normalize_price_csv(c).collect()] == [("A", "2024-01-02", 2.5)]


def test_head_and_cells_once(spark):
    """What a file's head says is worked out once a file, a record's cells once a record: not above the step that gives the records."""
    for parse in (xtb.xtb_rows, brokers.bossa_transactions, brokers.mbank_transactions, brokers.degiro_transactions, brokers.bossa_operations):
        plan = parse(files(spark, "a"))._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("Generate posexplode", 1)[0]
        assert not any(step in above for step in ("flatten", "array_position", "split(")), parse.__name__


def test_number_forms(spark):
    for text_, want in [("-1 234,50", -1234.5), ("1 234,50", 1234.5), (".5", 0.5), ("5.", 5.0), ("-", 0.0), ("1.234,5", 1.234), ("1e2", 100.0), ("007", 7.0), ("12345678901234567890,5", 12345678901234567890.5)]:
        assert one(spark, x.polish_number, text_) == want
    assert one(spark, x.dotted_date, "x 25.02.2026 09:47:27") == "2026-02-25T09:47:27"
    assert one(spark, x.serial_or_slashed_ts, "31/02/2019 12:00:01") is None


def test_rendered_files_are_dealt_out_by_number(spark):
    from folio.plans.imports import files

    rows = spark.createDataFrame([(f"f{i % 40}", 400 - i, f"line {i}") for i in range(400)], "file string, at long, line string")
    made = files(rows, F.lit("head"))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # none put together
    assert {r.file: r.content for r in made.collect()} == {
        f"f{k}": "\n".join(["head", *[f"line {i}" for i in range(360 + k, -1, -40)], ""]) for k in range(40)}
