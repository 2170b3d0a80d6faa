"""Writers: CSV with quoted line breaks, JSON lines, Parquet by partition, reports, and tables that are continued."""

from __future__ import annotations

import html
import json
from datetime import date, datetime, timezone
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import readers


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, gzip: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*(by or [])).parquet(path)


def tsv(df: DataFrame, path: str, text: str, label: str, part: str = "train", mode: str = "overwrite") -> None:
    """text, part and label parted by tabs, without a header; tabs and line breaks of a text become spaces."""
    rows = df.select(F.regexp_replace(text, r"[\t\r\n]+", " "), F.lit(part), F.col(label).cast("string"))
    rows.write.mode(mode).option("sep", "\t").option("header", False).option("quote", "").csv(path)


def stamped(folder: str, name: str, ending: str = "", at: datetime | None = None) -> str:
    """folder/name_YYYYmmdd_HHMMSS.ending, in UTC."""
    return f"{folder.rstrip('/')}/{name}_{(at or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}{ending}"


FORMATS = ("csv", "json", "parquet")


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that have no such columns."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested})


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> str:
    """Writes one of FORMATS; ValueError for another name, before anything runs."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    {"csv": lambda: csv(flat(df), path, mode), "json": lambda: json_lines(df, path, mode=mode), "parquet": lambda: parquet(df, path, mode=mode)}[kind]()
    return path


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, kind: str = "csv") -> int:
    """Adds the rows whose key isn't in the table yet, of each key one; returns how many. A run that is repeated adds nothing, one that was cut off goes on."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"can't continue {kind!r}")
    new = df.dropDuplicates([key])
    if readers.exists(spark, f"{path.rstrip('/')}/part-*"):
        old = spark.read.parquet(path) if kind == "parquet" else readers.csv_texts(spark, path)
        # Keys are compared as text, as CSV holds them.
        written = old.select(F.col(key).cast("string").alias("__key")).distinct()
        new = new.join(written, F.col(key).cast("string") == F.col("__key"), "left_anti")
    count = Observation()
    own = new.observe(count, F.count(F.lit(1)).alias("n"))
    (csv if kind == "csv" else parquet)(own, path, mode="append")
    return count.get["n"]


def native(x: Any) -> Any:
    """Rows, dates, decimals and numbers of other libraries as what JSON holds."""
    if isinstance(x, dict):
        return {str(k): native(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return native(x.asDict(recursive=True))
    if isinstance(x, (list, tuple, set)):
        return [native(v) for v in (sorted(x, key=repr) if isinstance(x, set) else x)]
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    if hasattr(x, "tolist"):
        return native(x.tolist())
    if isinstance(x, float) and x != x:
        return None
    return x


def json_report(report: dict[str, Any], path: str) -> str:
    """A report as JSON; tables among its values (of a few rows) become lists of rows."""
    out = {k: v.collect() if isinstance(v, DataFrame) else v for k, v in report.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(native(out), indent=2, ensure_ascii=False))
    return path


def tables(named: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Writes each table under its name."""
    return {name: save(df, f"{folder.rstrip('/')}/{name}", kind) for name, df in named.items()}


def provenance(spark: SparkSession, folder: str, **facts: Any) -> None:
    """Adds a line on a run (its facts and the time in UTC) to the folder's log."""
    line = json.dumps(native(facts | {"timestamp_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")}), ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{folder.rstrip('/')}/provenance")


def vocabulary(df: DataFrame, path: str, column: str = "segment") -> None:
    """A text file of one entry a line, in order."""
    df.select(column).orderBy(column).write.mode("overwrite").text(path)


def markdown(sections: dict[str, DataFrame], title: str, path: str, most: int = 50) -> str:
    """A report of tables, the first `most` rows of each."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(native(v)).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in df.limit(most).collect()] + [""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines))
    return path


def html_report(sections: dict[str, DataFrame], title: str, path: str, most: int = 50) -> str:
    """The same as a page."""
    cell = lambda v: html.escape("" if v is None else str(native(v)))
    parts = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1>']
    for name, df in sections.items():
        head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        parts.append(f"<h2>{cell(name)}</h2><table><tr>{head}</tr>{rows}</table>")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join([*parts, "</body></html>"]))
    return path


def reports(sections: dict[str, DataFrame], title: str, folder: str) -> dict[str, str]:
    """Each table as CSV, and all of them as Markdown and as a page."""
    out = tables(sections, folder, "csv")
    return out | {"markdown": markdown(sections, title, f"{folder}/report.md"), "html": html_report(sections, title, f"{folder}/report.html")}


def computed_once(spark: SparkSession, keys: DataFrame, key: str, make, path: str, version: str) -> DataFrame:
    """make(keys) for keys that the table at `path` doesn't hold for this version; what is made is added to it. Returns all that the keys ask for, whatever their order."""
    place = f"{path.rstrip('/')}/version={version}"
    wanted = keys.select(key).distinct()
    if readers.exists(spark, f"{place}/part-*"):
        missing = wanted.join(spark.read.parquet(place).select(key), key, "left_anti")
        if missing.head(1):
            make(missing).write.mode("append").parquet(place)
    else:
        make(wanted).write.mode("append").parquet(place)
    return spark.read.parquet(place).dropDuplicates([key]).join(wanted, key, "left_semi")
