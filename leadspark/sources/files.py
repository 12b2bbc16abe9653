"""Readers of leads, conversations, catalogue and advisors, and writers of tables. Only Spark's readers touch files."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from leadspark.functions.fields import normalize_sender
from leadspark.functions.text import trim
from leadspark.operators.ingest import RAW
from leadspark.sources import splits

MESSAGE = "struct<emisor:string,sender:string,rol:string,role:string,tipo:string,hora:string,hour:string,time:string,texto:string,text:string,mensaje:string,message:string>"
CHAT = f"conversacion_id string, conversation_id string, id string, lead_id string, canal string, channel string, fecha_inicio string, started_at string, mensajes array<{MESSAGE}>, messages array<{MESSAGE}>"


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All-string rows of UTF-8 CSV files (byte-order mark or not) by header name, with row_number 1, 2, ... in file order.

    Missing columns are null, others are left out. Quoted fields may hold line breaks; a large file takes many tasks
    (splits.records). Files under path, by name, have one header each, like that of the first, and are numbered on.
    """
    found = splits.records(spark, path, splits.Lines())
    head = found.where("number = 0").orderBy("file").select("text").first()
    if head is None:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in columns), "row_number long"]))
    names = [c.strip() for c in next(csv.reader([head.text]))]
    fields = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = found.groupBy("file").agg(F.max("number").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = found.where("number > 0").withColumn("_r", F.from_csv("text", fields.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})).join(F.broadcast(offsets), "file")
    at = {c: i for i, c in reversed(list(enumerate(names)))}
    return rows.select(*((F.col(f"_r._{at[c]}") if c in at else F.lit(None).cast("string")).alias(c) for c in columns), (F.col("number") + F.col("_before")).alias("row_number"))


def read_leads_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RAW)


def coalesce_aliases(names: list[str], prefix: str = "") -> Column:
    """The first of several columns that is not null."""
    return F.coalesce(*(F.col(prefix + n) for n in names))


def read_conversations_json(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, lead_id, channel, started_at, messages) of a JSON array; objects without an id and other items are skipped.

    messages: array of (seq, sender, hour, text); seq is the place in the source array. A large array takes many tasks
    (splits.records).
    """
    raw = splits.records(spark, path, splits.Objects()).select(F.from_json("text", CHAT, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    message = lambda m, i: F.when(m.isNotNull(), F.struct((i + 1).alias("seq"), normalize_sender(F.coalesce(m["emisor"], m["sender"], m["rol"], m["role"], m["tipo"])).alias("sender"),
                                                          F.coalesce(m["hora"], m["hour"], m["time"], F.lit("")).alias("hour"), F.coalesce(m["texto"], m["text"], m["mensaje"], m["message"], F.lit("")).alias("text")))
    out = raw.select(trim(coalesce_aliases(["conversacion_id", "conversation_id", "id"])).alias("conversation_id"), "lead_id", coalesce_aliases(["canal", "channel"]).alias("channel"), coalesce_aliases(["fecha_inicio", "started_at"]).alias("started_at"),
                     F.array_compact(F.transform(F.coalesce("mensajes", "messages", F.array().cast(f"array<{MESSAGE}>")), message)).alias("messages"))
    return out.where("conversation_id <> ''")


def load_catalog(rows: DataFrame) -> DataFrame:
    """Catalogue rows typed: engine size, decimal price, branches as an array without empty parts."""
    return rows.select(F.trim("sku").alias("sku"), F.trim("marca").alias("brand"), F.trim("linea").alias("line"), F.trim("cilindraje").try_cast("int").alias("engine_cc"), F.trim("segmento").alias("segment"), F.trim("precio_lista").try_cast("decimal(12,2)").alias("list_price"),
                       F.struct(F.filter(F.transform(F.split(F.coalesce("puntos_venta_disponibles", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "").alias("points_of_sale"), F.trim("unidades_disponibles").try_cast("int").alias("units_total")).alias("availability"))


def load_advisors(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("asesor_id").alias("advisor_id"), F.trim("nombre").alias("name"), F.trim("punto_venta_id").alias("point_of_sale_id"), F.trim("empresa_id").alias("company_id"), F.trim("capacidad_diaria_leads").try_cast("int").alias("daily_capacity"),
                       (F.upper(F.trim("activo")) == "SI").alias("active"), F.try_to_date(F.trim("fecha_ingreso"), "yyyy-MM-dd").alias("start_date"))


def org_dimension(advisors: DataFrame) -> DataFrame:
    """(point_of_sale_id, company_id): of a branch's roster rows the last one's company."""
    return advisors.groupBy("point_of_sale_id").agg(F.max_by("company_id", "row_number").alias("company_id"))


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", by: dict[str, list[str]] | None = None) -> None:
    """Each table under path/name, partitioned by the columns given for it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if by and name in by:
            writer = writer.partitionBy(*by[name])
        writer.save(f"{path}/{name}")
