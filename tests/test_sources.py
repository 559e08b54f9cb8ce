import csv
import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerscan.operators import columns as cols
from ledgerscan.operators import preview
from ledgerscan.operators.setops import append
from ledgerscan.sources import fill_defaults, infer_types, make_unique, read_any, read_csv, read_json, save, value_index, write
from ledgerscan.streaming import check_stream


def test_make_unique():
    assert make_unique([" a ", "a", "", None, "a", "b"]) == ["a", "a_2", "Col_2", "Col_3", "a_3", "b"]


def test_csv_bom_short_and_long_lines(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text("﻿Product,Quantity,\nPen,1,x\nBook,2\nInk,3,y,extra\n\"a,b\",4,z\n", encoding="utf-8")
    df = read_any(spark, str(path))
    assert df.columns == ["Product", "Quantity", "Col_2"]
    assert sorted(tuple(r) for r in df.collect()) == [("Book", "2", None), ("Pen", "1", "x"), ("a,b", "4", "z")]


def test_csv_header_row_and_skiprows(spark, tmp_path):
    path = tmp_path / "report.txt"
    path.write_text("title\nName;Age\nskip me;0\nAyşe;30\nÖmer;40\n", encoding="utf-8")
    df = read_csv(spark, str(path), sep=";", header_row=1)
    assert df.columns == ["Name", "Age"] and df.count() == 3
    path.write_text("Name;Age\nunits;years\nAyşe;30\n", encoding="utf-8")
    df = read_csv(spark, str(path), sep=";", skiprows=1)
    assert [tuple(r) for r in df.collect()] == [("Ayşe", "30")]


def test_csv_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("ad,no\nGökçe,1\n".encode("iso-8859-1"))
    assert read_csv(spark, str(path), encoding="ISO-8859-1").first().ad == "Gökçe"


def test_csv_charsets(spark, tmp_path):
    turkish = "İstanbul, ığşĞ “€”"
    for kind, name in (("windows-1254", "tr"), ("windows-1252", "de"), ("ISO-8859-9", "iso"), ("cp857", "dos")):
        (tmp_path / name).write_bytes(f"ad;no\n{turkish};1\nÇ;2\n".encode(kind, "replace"))
        got = sorted(tuple(r) for r in read_csv(spark, str(tmp_path / name), sep=";", encoding=kind).collect())
        assert got == sorted([("Ç", "2"), (turkish.encode(kind, "replace").decode(kind), "1")])
    report = tmp_path / "report.csv"
    report.write_bytes("başlık\nad,no\ncafé,1\n".encode("ISO-8859-9"))
    assert [tuple(r) for r in read_csv(spark, str(report), encoding="ISO-8859-9", header_row=1).collect()] == [("café", "1")]
    with pytest.raises(ValueError):
        read_csv(spark, str(report), encoding="UTF-16", header_row=1)


def test_sink_charset(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ğİşı Ð 你"), (2, None)], "no int, `Açıklama` string")
    path = write(df, str(tmp_path / "out"), "csv", encoding="windows-1254")
    assert sorted(tuple(r) for r in read_csv(spark, path, encoding="windows-1254").collect()) == [("1", "Ğİşı ? ?"), ("2", None)]
    with pytest.raises(ValueError):
        write(df, path, "json", encoding="windows-1254")


def test_csv_headers_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b, c d.csv").write_text("b,a\n3,4\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "z.csv").write_text("\ufeffc,a,\n5,6,7\n", encoding="utf-8")
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c", "Col_2"]
    assert sorted(map(str, df.collect())) == sorted(map(str, [Row(*df.columns)(*r) for r in [("1", "2", None, None), ("4", "3", None, None), ("6", None, "5", "7")]]))


def fields(rnd):
    return rnd.choice(["", "x", "a b", 'say "hi"', '"', '""', "line\nbreak", "\n", "a,b", ' "lead', "tail ", "ü\n\n,\"\",\n", "plain"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_csv_line_breaks_over_tiny_ranges(spark, tmp_path, seed):
    """One file, cut into ranges of a few bytes: the same records as a reader that sees the whole file."""
    rnd = random.Random(seed)
    rows = [[str(k), *(fields(rnd) for _ in range(3))] for k in range(150)]
    path = tmp_path / "big.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL, lineterminator="\r\n" if seed == 2 else "\n")
        out.writerows([["id", "one", 'two\n"second"', "three"], *rows])
    key, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "300")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        df = read_csv(spark, str(path))
        got = sorted((tuple(v or "" for v in r) for r in df.collect()), key=lambda r: int(r[0]))
    finally:
        spark.conf.set(key, usual)
    assert df.columns == ["id", "one", 'two\n"second"', "three"]
    assert got == [tuple(v.replace("\r\n", "\n") for v in r) for r in rows]


def test_csv_marks_inside_plain_values(spark, tmp_path):
    """Quotes that do not begin a value are letters, as for Spark's own reader."""
    path = tmp_path / "inches.csv"
    path.write_text('id,size,note\n1,5" pipe,x\n2,"a\nb",6" y\n3,"q"" z",""\n4,plain,"two\n\nbreaks"\n5,x,y\n')
    got = sorted(tuple(r) for r in read_csv(spark, str(path)).collect())
    own = spark.read.csv(str(path), header=True, multiLine=True, escape='"')
    assert got == sorted(tuple(r) for r in own.collect())
    path.write_text('id,v\n1,a\n2,"never closed\n3,b\n')
    assert len(read_csv(spark, str(path)).collect()) == 3


def test_json_shapes(spark, tmp_path):
    array, single, lines = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    array.write_text('[{"a": 1, "b": "x"},\n {"a": 2.5}]')
    single.write_text('{\n "a": 1,\n "b": true}')
    lines.write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2}\n')
    assert sorted(tuple(r) for r in read_any(spark, str(array)).collect()) == [("1", "x"), ("2.5", None)]
    assert [tuple(r) for r in read_json(spark, str(single)).collect()] == [("1", "true")]
    assert sorted(tuple(r) for r in read_json(spark, str(lines)).collect()) == [("1", "x"), ("2", None)]


def test_xml(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text('<ledger><row no="7"><a>1</a><b> x </b></row><row no="8"><a>2</a></row></ledger>')
    df = read_any(spark, str(path), row_tag="row")
    assert sorted(tuple(r) for r in df.select("@no", "a", "b").collect()) == [("7", "1", "x"), ("8", "2", None)]


@pytest.mark.parametrize("kind", ["csv", "txt", "tsv", "json", "parquet"])
def test_sinks_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(
        [(1, dt.datetime(2026, 1, 5, 10, 0), 2.5, 'şöyle "dedi",\tson'), (2, None, None, None)],
        "A int, Tarih timestamp_ntz, Tutar double, `Açıklama` string",
    )
    path = write(df, str(tmp_path / kind), kind)
    back = read_any(spark, path, {"txt": "tsv", "json": "jsonl"}.get(kind, kind))
    got = sorted(tuple(str(v) for v in r) for r in back.select("A", "Tutar", "Açıklama").collect())
    assert got[0] == ("1", "2.5", 'şöyle "dedi",\tson')
    assert got[1][:2] == (("2", "None") if kind == "parquet" else ("2", "0.0"))
    with pytest.raises(ValueError):
        write(df, path, "xlsx")


def test_empty_result_keeps_its_header(spark, tmp_path):
    df = spark.createDataFrame([], "A string, B string")
    path = write(df.coalesce(1), str(tmp_path / "none"), "csv")
    assert read_any(spark, path, "csv").columns == ["A", "B"]


def test_row_capped_parts(spark, tmp_path):
    path = write(spark.range(2500).coalesce(1), str(tmp_path / "parts"), "parquet", rows_per_file=1000)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert sorted(r["count"] for r in sizes.collect()) == [500, 1000, 1000]


def test_fill_defaults(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), None, None, None), (1, 2.0, True, "a", dt.datetime(2026, 1, 1))],
        "i int, d double, b boolean, s string, t timestamp_ntz",
    )
    assert tuple(fill_defaults(df).orderBy("i").first()) == (0, 0.0, False, "", None)


def test_types_and_values(spark):
    df = spark.createDataFrame([(str(i), f"{i % 28 + 1:02d}.03.2024", f"n{i % 3}", None) for i in range(60)], "a string, b string, c string, d string")
    assert infer_types(df) == {"a": "numeric", "b": "date", "c": "text", "d": "text"}
    index = value_index(df, max_unique=30).groupBy("column").count()
    assert {r["column"]: r["count"] for r in index.collect()} == {"b": 28, "c": 3}


def test_type_labels_ignore_the_layout(spark):
    """The sample is the 500 rows with the smallest digests, however the rows lie in files and whatever repeats."""
    import hashlib

    values = [(i, "x" if i % 20 < 3 else "7.5", "same", None if i % 900 else "15 Jan 2026 2:30 PM") for i in range(4000)]
    df = spark.createDataFrame(values, "k int, near string, word string, rare string")
    sample = sorted(values, key=lambda v: hashlib.md5(str(v[0]).encode()).hexdigest())[:500]
    share = sum(v[1] == "7.5" for v in sample) / 500
    near = "numeric" if share > 0.85 else "date"
    expected = {"k": "numeric", "near": near, "word": "text", "rare": "date"}
    assert infer_types(df, key=["k"]) == expected
    assert infer_types(df.repartition(7).orderBy(F.desc("k")), key=["k"]) == expected
    same = spark.range(3000).select(F.lit("12").alias("a"), F.lit(None).cast("string").alias("b"))
    assert infer_types(same) == {"a": "numeric", "b": "text"}
    assert infer_types(same.limit(0)) == {"a": "text", "b": "text"}


def test_append_and_save(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([("2", 5.0)], "k string, v double")
    out = append([a, b])
    assert sorted(tuple(r) for r in out.select("k", "s", "v").collect()) == [("1", "x", 0.0), ("2", "", 5.0)]
    save(a, "kept")
    save(b, "kept", "append", append_to=a)
    assert spark.table("kept").count() == 2
    save(b, "kept", "replace")
    assert spark.table("kept").columns == ["k", "v"]
    with pytest.raises(ValueError):
        save(a, "kept", "somehow")


def test_preview(spark):
    df = spark.createDataFrame(
        [(1, "31.01.2026", "a"), (2, "2026-01-01", "Özel not"), (3, "05.01.2026", "b"), (4, "not a date", "c")],
        "ID int, TARIH string, ACIKLAMA string",
    )
    assert [r.ID for r in preview.search(df, anywhere="özel").collect()] == [2]
    rows, total = preview.page(df, sort_by="TARIH", order_by=["ID"])
    assert [r.ID for r in rows.collect()] == [2, 3, 1, 4] and total.first().total == 4
    rows, _ = preview.page(df, sort_by="TARIH", ascending=False, order_by=["ID"])
    assert [r.ID for r in rows.collect()] == [1, 3, 2, 4]
    rows, _ = preview.page(df, page=1, per=3, order_by=["ID"])
    assert [r.ID for r in rows.collect()] == [4]


def test_column_tools(spark):
    df = spark.createDataFrame([(1, "2,5", ""), (2, "x", None)], "id int, `tutar TL` string, note string")
    out = cols.with_formula(df, "twice", "tutar_TL * 2").orderBy("id").collect()
    assert [r.twice for r in out] == [5.0, None] and out[0]["tutar TL"] == "2,5"
    assert [r.note for r in cols.fillna(df, ["note"], "none").collect()] == ["none", "none"]
    assert cols.with_formula(df, "note", F.lit(1)).columns == df.columns
    assert cols.with_formula(df, "n", "length(note)", numeric=False).orderBy("id").first().n == 0
    with pytest.raises(ValueError):
        cols.run_steps(df, [{"formula_id": "unknown"}])
    with pytest.raises(ValueError):
        cols.fillna(df, [])


def test_row_checks_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, -5.0), (2, 3.0), (3, -1.0)], "rid int, x double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = check_stream(stream, "negative", "x")
    query = found.writeStream.format("memory").queryName("negatives").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.rid for r in spark.table("negatives").collect()) == [1, 3]
    with pytest.raises(ValueError):
        check_stream(stream, "duplicates", "x")


def test_many_places_of_lines_are_not_broadcast(spark, tmp_path, monkeypatch):
    from ledgerscan.sources import delimited

    path = tmp_path / "notes.csv"
    path.write_text("id,note\n" + "".join(f'{k},"a\nb {k}"\n' for k in range(200)), encoding="utf-8")
    monkeypatch.setattr(delimited, "BROADCAST_LINES", 100)
    found = delimited.records(delimited.numbered_lines(delimited.raw_lines(spark, str(path), "UTF-8")), ",")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__no" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "__no" in x]
    assert found.filter("no > 0").count() == 200
    assert sorted(r.note for r in read_csv(spark, str(path)).collect()) == sorted(f"a\nb {k}" for k in range(200))
