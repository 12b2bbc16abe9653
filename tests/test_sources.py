"""Readers and writers on small files."""

import csv
import io
import json
import random

import pytest

from leadspark.sources import files, published, splits


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 300 bytes, a task each."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_csv_over_many_ranges_keeps_rows_and_numbers(spark, tmp_path, small_ranges, seed):
    r = random.Random(seed)
    value = lambda: r.choice(["", "plain", "with, comma", 'a "quoted" word', "two\nlines", "three\n\n\nlines", "x" * r.randrange(700), "é ñ", "\r\nbreak"])
    rows = [[f"LD-{i}", value(), value()] for i in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows([["lead_id", "telefono", "ciudad"], *rows])
    p = tmp_path / "leads.csv"
    p.write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    df = files.read_csv(spark, str(p), ("lead_id", "telefono", "ciudad", "email"))
    got = {x.row_number: [x.lead_id, x.telefono or "", x.ciudad or ""] for x in df.collect()}
    assert got == {i: x for i, x in enumerate(rows, 1)}
    assert spark.read.text(str(p)).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_over_many_ranges_keeps_objects_and_skips_other_items(spark, tmp_path, small_ranges, indent):
    r = random.Random(3)
    text = lambda: r.choice(["hola", 'a "b" } {', "back\\slash\\", "[{]}", "x" * r.randrange(900), "} \\\" ] é", "", "line\nbreak"])
    talks = [{"conversation_id": f"C{i}", "lead_id": f"L{i}", "messages": [{"emisor": "cliente", "texto": text()} for _ in range(r.randrange(4))]} for i in range(60)]
    items = []
    for t in talks:
        items += [*r.choice([[], [5], ["} text {"], [[1, {"conversation_id": "nested"}]], [None]]), t]
    p = tmp_path / "talks.json"
    p.write_text(json.dumps([*items, "end", [{}]], indent=indent, ensure_ascii=False))
    got = {x.conversation_id: (x.lead_id, [m.text for m in x.messages]) for x in files.read_conversations_json(spark, str(p)).collect()}
    assert got == {t["conversation_id"]: (t["lead_id"], [m["texto"] for m in t["messages"]]) for t in talks}
    assert splits.records(spark, str(p), splits.Objects()).count() == 60 and spark.read.option("lineSep", "}").text(str(p)).rdd.getNumPartitions() > 10


def test_empty_files_have_no_records(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "none.json").write_text(" [ ] ")
    assert files.read_leads_csv(spark, str(tmp_path / "none.csv")).count() == 0 and files.read_conversations_json(spark, str(tmp_path / "none.json")).count() == 0


def test_leads_csv(spark, tmp_path):
    p = tmp_path / "leads.csv"
    p.write_text('﻿lead_id,telefono,ciudad\nLD-1,"300, 1","Bo""g\notá"\nLD-2,,Cali\n', encoding="utf-8")
    got = files.read_leads_csv(spark, str(p)).orderBy("row_number").collect()
    assert [(r.lead_id, r.telefono, r.ciudad, r.email) for r in got] == [("LD-1", "300, 1", 'Bo"g\notá', None), ("LD-2", None, "Cali", None)]


def test_conversations_json(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"conversacion_id": "C1", "lead_id": "L", "canal": "w", "mensajes": [{"emisor": "Client", "texto": "hola", "hora": "1"}, None, {"role": "agent", "text": "si"}]}, {"conversation_id": "", "messages": []}, {"lead_id": "x"}]))
    got = files.read_conversations_json(spark, str(p)).collect()
    assert len(got) == 1 and [(m.seq, m.sender, m.text) for m in got[0].messages] == [(1, "cliente", "hola"), (3, "asesor", "si")]


def test_catalog_advisors_and_tables(spark, tmp_path):
    c = spark.createDataFrame([(" S1 ", "Honda", "CB", "125", "x", "4990000", "P1| |P2", "7")], "sku string, marca string, linea string, cilindraje string, segmento string, precio_lista string, puntos_venta_disponibles string, unidades_disponibles string")
    r = files.load_catalog(c).first()
    assert r.sku == "S1" and r.availability.points_of_sale == ["P1", "P2"] and float(r.list_price) == 4990000
    a = files.load_advisors(spark.createDataFrame([("A", "N", "P", "E", "5", " si ", "2024-02-30")], "asesor_id string, nombre string, punto_venta_id string, empresa_id string, capacidad_diaria_leads string, activo string, fecha_ingreso string")).first()
    assert (a.daily_capacity, a.active, a.start_date) == (5, True, None)
    files.write_tables({"t": spark.createDataFrame([("E", 1)], "company_id string, n int")}, f"file://{tmp_path}/out", by={"t": ["company_id"]})
    assert spark.read.parquet(f"file://{tmp_path}/out/t").first().n == 1 and files.file_hashes(spark, f"file://{tmp_path}/out/t/*/*.parquet").count() == 1


def test_published_partitions_and_killed_runs(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = lambda rows: spark.createDataFrame(rows, "company_id string, run_date string, n int")
    by, held = ["company_id", "run_date"], lambda v=None: sorted(tuple(r) for r in published.read(spark, path, v).select("company_id", "run_date", "n").collect())
    assert published.publish(df([("E1", "d1", 1), ("E1", "d2", 2), ("E2", "d1", 3)]), path, by, "first") == 1
    published.stage(df([("E1", "d1", 99)]), path, by, "killed")  # a run that ends before its manifest
    assert held() == [("E1", "d1", 1), ("E1", "d2", 2), ("E2", "d1", 3)]
    assert published.publish(df([("E1", "d1", 7), ("E1", "d1", 8), ("E3", "d1", 9)]), path, by, "second") == 2
    assert held() == [("E1", "d1", 7), ("E1", "d1", 8), ("E1", "d2", 2), ("E2", "d1", 3), ("E3", "d1", 9)] and held(1) == [("E1", "d1", 1), ("E1", "d2", 2), ("E2", "d1", 3)]
    late = published.stage(df([("E2", "d1", 0)]), path, by, "late")
    with pytest.raises(RuntimeError):  # both began with version 1
        published.commit(spark, path, late, 1)
    assert published.publish(df([]), path, by) == 3 and len(held()) == 5
    assert "company_id" in published.read(spark, path).where("company_id = 'E3'")._jdf.queryExecution().executedPlan().toString()
    assert published.expire(spark, path, 1) == 1 and len(held()) == 5 and published.versions(spark, path) == [3]
