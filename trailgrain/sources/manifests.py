"""Small files that people write: points of interest, annotations, timelines, labels and properties, as tables.

Each is read through Spark, so it may lie where only Spark reads, and is small enough to be checked as a whole.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POIS = "event_id string, group_id string, window_start_ns long, window_end_ns long"


def text_of(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return (row[0] if row else "").removeprefix("﻿")


def unique(ids: list, what: str) -> list[str]:
    if not isinstance(ids, list) or not all(isinstance(i, str) and i for i in ids) or len(set(ids)) != len(ids):
        raise ValueError(f"{what} must be a list of different ids")
    return ids


def groups_of(raw: list[dict]) -> list[tuple]:
    """Rows (event_id, group_id, window_start_ns, window_end_ns); a window has both ends, in order, or none."""
    rows, seen = [], set()
    for g in raw:
        ids, lo, hi = unique(g["seed_event_ids"], f"group {g.get('group_id')}"), g.get("window_start_ns"), g.get("window_end_ns")
        if (lo is None) != (hi is None) or (lo is not None and lo > hi):
            raise ValueError(f"group {g['group_id']} has half a window or one that ends before it starts")
        if g["group_id"] in seen:
            raise ValueError(f"group {g['group_id']} occurs twice")
        seen.add(g["group_id"])
        rows += [(i, g["group_id"], lo, hi) for i in ids]
    return rows


def poi_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest from a JSON list, a JSON object with groups, or lines of text with # comments."""
    text = text_of(spark, path)
    if text.lstrip()[:1] in ("[", "{"):
        raw = json.loads(text)
        ids = unique(raw if isinstance(raw, list) else raw.get("event_ids", []), "event_ids")
        rows = groups_of(raw.get("seed_event_groups", [])) if isinstance(raw, dict) else []
        if rows and ids and {r[0] for r in rows} != set(ids):
            raise ValueError("event_ids and groups name different events")
        rows = rows or [(i, None, None, None) for i in ids]
    else:
        lines = [line.split("#", 1)[0].strip() for line in text.splitlines()]
        rows = [(i, None, None, None) for i in unique([line for line in lines if line], "lines")]
    return spark.createDataFrame(rows, POIS)


def annotations(spark: SparkSession, path: str, need_seeds: bool = True) -> dict[str, DataFrame]:
    """events (event_id, role), nodes (uuid, role), groups (as points of interest) and paths (path, position, event_id) of annotations."""
    raw = json.loads(text_of(spark, path))
    role = lambda key, name: [(i, name) for i in unique(raw.get(key, []), key)]
    events = role("seed_event_ids", "seed") + role("attack_event_ids", "attack")
    nodes = role("seed_uuids", "seed") + role("attack_node_uuids", "attack")
    if need_seeds and not any(r == "seed" for _, r in events + nodes):
        raise ValueError(f"{raw.get('name')} has no seeds")
    known = {i for i, _ in events}
    paths = [(k, j, i) for k, p in enumerate(raw.get("attack_paths", [])) for j, i in enumerate(unique(p, f"path {k}"))]
    if any(i not in known for _, _, i in paths):
        raise ValueError("a path names an event that is not labelled")
    return {
        "events": spark.createDataFrame(events, "event_id string, role string"), "nodes": spark.createDataFrame(nodes, "uuid string, role string"),
        "groups": spark.createDataFrame(groups_of(raw.get("seed_event_groups", [])), POIS), "paths": spark.createDataFrame(paths, "path int, position int, event_id string"),
    }


def timeline(spark: SparkSession, path: str, prefix: int | None = None) -> DataFrame:
    """Ordered points of interest with their certificate path: (place, event_id, path, position), those of the first `prefix` places.

    The paths must hold every event once and follow the declared order.
    """
    raw = json.loads(text_of(spark, path))
    ids = unique(raw["event_ids"], "event_ids")
    place = {i: k for k, i in enumerate(ids)}
    rows = [(place.get(i), i, k, j) for k, p in enumerate(raw["paths"]) for j, i in enumerate(p)]
    if sorted(i for _, i, _, _ in rows) != sorted(ids):
        raise ValueError("the paths do not hold each event once")
    if any(a[2] == b[2] and a[0] > b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("a path leaves the declared order")
    return spark.createDataFrame([r for r in rows if prefix is None or r[0] < prefix], "place int, event_id string, path int, position int")


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels without a header: uuid in upper case, and the attributes as they are written."""
    rows = spark.read.schema("uuid string, attributes string").csv(path, quote='"', escape='"')
    return rows.where("trim(uuid) <> ''").select(F.upper(F.trim("uuid")).alias("uuid"), "attributes")


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys and values of lines `key = value`; # and ! begin comments."""
    pairs = (line.split("=", 1) for line in text_of(spark, path).splitlines() if "=" in line and line.lstrip()[:1] not in ("#", "!"))
    return {k.strip(): v.strip() for k, v in pairs}
