"""JSON and XML."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import function


@function("json_util.to_json")
def to_json(value: Column) -> Column:
    """A struct, map or array as JSON; nulls within are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


@function("json_util.from_json_list")
def from_json_list(json_str: Column) -> Column:
    """array<variant> of a JSON list; null for null; anything else raises."""
    v = F.parse_json(json_str)
    ok = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(json_str.isNull(), F.lit(None)).when(ok, v.cast("array<variant>")).otherwise(F.raise_error(F.lit("not a JSON list")))


@function("json_util.load_from_path")
def load_from_path(spark: SparkSession, path: str) -> DataFrame:
    """A row for each object of a file that holds a list of objects or one object."""
    return spark.read.json(path, multiLine=True)


@function("json_util.load_from_str")
def load_from_str(spark: SparkSession, json_str: str) -> DataFrame:
    value = json.loads(json_str)
    return spark.createDataFrame([(json.dumps(x),) for x in (value if isinstance(value, list) else [value])], "text string").select(F.parse_json("text").alias("objects"))


@function("json_util.load_from_url")
def load_from_url(spark: SparkSession, url: str) -> DataFrame:
    from urllib.request import urlopen

    with urlopen(url) as r:
        return load_from_str(spark, r.read().decode())


def element(e: ET.Element, simple: bool) -> dict[str, Any]:
    """_type, attributes, _text and _children; simple puts children under _tag."""
    out: dict[str, Any] = {"_type": e.tag, **e.attrib}
    if e.text and e.text.strip():
        out["_text"] = e.text
    if simple:
        for c in e:
            out.setdefault(f"_{c.tag}", []).append(element(c, True))
    elif len(e):
        out["_children"] = [element(c, False) for c in e]
    return out


def parse_xml(text: str, simple: bool = False, xpath: str = "") -> list[dict[str, Any]]:
    if "<!ENTITY" in text or "<!DOCTYPE" in text:
        raise ValueError("document types and entities are not read")
    root = ET.fromstring(text)
    return [element(e, simple) for e in (root.findall(xpath) if xpath else [root])]


@function("xml_module.parse")
def xml_parse(xml_input: Column, simple: bool = False) -> Column:
    """The parsed document as a variant."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: json.dumps(parse_xml(v, simple)[0]) if v is not None else None)

    return F.parse_json(run(xml_input))


@function("xml_module.load")
def xml_load(spark: SparkSession, xml_url: str, simple: bool = False, path: str = "", xpath: str = "", headers: dict[str, str] | None = None) -> DataFrame:
    """(output_map: variant): a row for each element that xpath finds (the root without one) in a file or at a URL."""
    if path:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    else:
        if not re.search(r"\.xml$", xml_url):
            raise ValueError("the URL must end in .xml")
        from urllib.request import Request, urlopen

        with urlopen(Request(xml_url, headers=headers or {})) as r:
            text = r.read().decode()
    rows = [(json.dumps(x),) for x in parse_xml(text, simple, xpath)]
    return spark.createDataFrame(rows, "t string").select(F.parse_json("t").alias("output_map"))
