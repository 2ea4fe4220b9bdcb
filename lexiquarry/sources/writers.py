"""Writers of entities and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_json(docs: DataFrame, entities: DataFrame, id: str = "doc_id") -> DataFrame:
    """(doc_id, json): each document's entities as a JSON array in order; without any, []."""
    none = F.array().cast("array<string>")
    one = F.struct(
        "ord",
        F.struct("text", F.array("start", "end").alias("position"), "type", F.coalesce("assertions", none).alias("assertions"), F.coalesce("candidates", none).alias("candidates")).alias("e"),
    )
    lists = entities.groupBy(id).agg(F.sort_array(F.collect_list(one)).alias("es"))
    value: Column = F.coalesce(F.to_json(F.transform("es", lambda x: x["e"]), {"pretty": "false"}), F.lit("[]"))
    return docs.select(id).distinct().join(lists, id, "left").select(id, value.alias("json"))


def write_entity_files(docs: DataFrame, entities: DataFrame, path: str, id: str = "doc_id") -> None:
    """One JSON file for each document, in a folder named by it (id=.../part-*.txt), through Spark's own writer; replaces what is there."""
    entity_json(docs, entities, id).write.mode("overwrite").partitionBy(id).text(path)


def export_entity_files(docs: DataFrame, entities: DataFrame, folder: str, id: str = "doc_id", indent: int = 2) -> None:
    """<doc_id>.json files in a folder that every executor shares, written task by task; each file is replaced as a whole."""

    def write(rows) -> None:
        import json
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as f:
                json.dump(json.loads(r["json"]), f, ensure_ascii=False, indent=indent)
            os.replace(part, os.path.join(folder, f"{r[id]}.json"))

    entity_json(docs, entities, id).foreachPartition(write)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def zip_folder(folder: str, file: str) -> None:
    """An archive of an exported folder's JSON files, on the driver; the export's size bounds it."""
    import os
    import zipfile

    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                z.write(os.path.join(folder, name), name)
