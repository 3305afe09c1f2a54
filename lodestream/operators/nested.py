"""Deeply nested records into flat node tables with interval labels.

Every JSON value of a content becomes a node with a pre-order and a post-order number from one depth-first
walk of its record. Node *a* encloses node *d* exactly if ``a.pre < d.pre AND a.post > d.post`` in the same
record, so tables that were split by type are linked again by containment, without the paths (``contain``).

Scale: contents are parsed once, in a narrow pass, and not shuffled; ``contain`` is a merge of two node tables sorted by record and
pre-order number, so a record costs what its nodes are and never their pairs. Defined results: NULL
or unreadable JSON gives no nodes, a bare string is one node, empty arrays are nodes without children, and
a key that occurs twice in an object counts once, with its last value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .records import event_time, holding

NODE_SCHEMA = (
    "rec_id long, uuid string, session_id string, rec_ts string, loaded_at timestamp_ntz, pre int, post int, depth int, kind string, is_element boolean, "
    "node_path string, node_type string, call_key string, result_key string, value string"
)
KEYS = ["rec_id", "uuid", "session_id", "rec_ts", "loaded_at"]
_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def label(doc: object) -> list[list]:
    """Nodes of one document in pre-order: [pre, post, depth, kind, is_element, path, value]. Iterative, so depth is no limit."""
    nodes: list[list] = []
    post = 0
    stack: list[tuple] = [(doc, "", 0, False, None)]
    while stack:
        value, path, depth, element, done = stack.pop()
        if done is not None:
            done[1] = post
            post += 1
            continue
        node = [len(nodes), 0, depth, _KIND[type(value)], element, path, value]
        nodes.append(node)
        stack.append((None, "", 0, False, node))
        if isinstance(value, dict):
            children = [(v, f"{path}.{k}" if path else k, depth + 1, False, None) for k, v in value.items()]
        elif isinstance(value, list):
            children = [(v, f"{path}.{i}" if path else str(i), depth + 1, True, None) for i, v in enumerate(value)]
        else:
            continue
        stack.extend(reversed(children))
    return nodes


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def shred(records: DataFrame, kinds: tuple[str, ...] = ("object", "array", "string", "number", "boolean", "null"), elements_only: bool = False, fields: bool = False) -> DataFrame:
    """Node table of the contents of all rows (not yet one version per ``uuid``); see the module's text.

    A top-level ``tool_use`` block carries its id in ``call_key``, a top-level ``tool_result`` its reference in
    ``result_key``. Scalars carry their text in ``value``, objects, with ``fields``, the JSON of their scalar members. Nothing but the named columns is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for key in zip(pdf.rec_id, pdf.uuid, pdf.session_id, pdf.rec_ts, pdf.loaded_at, pdf.msg_content):
                try:
                    doc = json.loads(key[5])
                except (ValueError, TypeError, RecursionError):
                    continue
                for n in label(doc):
                    if n[3] not in kinds or elements_only and not n[4]:
                        continue
                    v, obj, top = n[6], n[3] == "object", n[3] == "object" and n[4] and n[2] == 1
                    kind = _text(v.get("type")) if obj else None
                    if obj:
                        value = json.dumps({k: x for k, x in v.items() if not isinstance(x, (dict, list))}, ensure_ascii=False) if fields else None
                    else:
                        value = None if isinstance(v, list) or v is None else v if isinstance(v, str) else json.dumps(v)
                    calls = _text(v.get("id")) if top and kind == "tool_use" else None, _text(v.get("tool_use_id")) if top and kind == "tool_result" else None
                    rows.append((*key[:5], n[0], n[1], n[2], n[3], n[4], n[5], kind, *calls, value))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return records.select(*KEYS, "msg_content").where("msg_content IS NOT NULL").mapInPandas(run, NODE_SCHEMA)


COLUMNS = [x.split()[0] for x in NODE_SCHEMA.split(", ")]


def hold_nodes(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes of the version that holds of each ``uuid``, also where that version has none. Contents are never shuffled."""
    keep = holding(records.select("rec_id", "uuid", "loaded_at")).select("rec_id")
    return nodes.join(keep, "rec_id", "left_semi")


def link_calls(nodes: DataFrame) -> DataFrame:
    """Add ``call_uuid``: for a top-level tool result the record of its session that made the call, else ''.

    Tool ids are unique within a session only, so the join key is (session, id); if an id was called twice the
    earliest call holds. A result without session or call gets ''. Only results are joined.
    """
    calls = (
        nodes.where("call_key IS NOT NULL AND session_id IS NOT NULL")
        .groupBy("session_id", F.col("call_key").alias("result_key"))
        .agg(F.min_by("uuid", F.struct(event_time(F.col("rec_ts")), "uuid")).alias("call_uuid"))
    )
    linked = nodes.where("result_key IS NOT NULL").join(calls, ["session_id", "result_key"], "left").withColumn("call_uuid", F.coalesce("call_uuid", F.lit("")))
    return linked.unionByName(nodes.where("result_key IS NULL").withColumn("call_uuid", F.lit("")))


def contain(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Link two node tables of the same records by interval containment: add to each descendant its closest ancestor (``ancestor_pre``, ``ancestor_path``), or NULLs.

    Both tables, sorted together by record and pre-order number, pass once; the open ancestors of a record are a stack, from which those go whose
    post-order number is below the node's. A node is no ancestor of itself.
    """
    schema = T.StructType([*descendants.schema.fields, T.StructField("ancestor_pre", T.IntegerType()), T.StructField("ancestor_path", T.StringType())])
    names = descendants.columns
    a = ancestors.select("rec_id", "pre", "post", "node_path", F.lit(True).alias("_opens"))
    both = descendants.withColumn("_opens", F.lit(False)).unionByName(a, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, opened = None, []
        for b in batches:
            rec, pre, post, path, opens = (b.column(n).to_pylist() for n in ("rec_id", "pre", "post", "node_path", "_opens"))
            at, near = [], []
            for i in range(len(rec)):
                if rec[i] != record:
                    record, opened = rec[i], []
                while opened and opened[-1][1] < post[i]:
                    opened.pop()
                if opens[i]:
                    opened.append((pre[i], post[i], path[i]))
                else:
                    at.append(i)
                    near.append(opened[-1] if opened else (None, None, None))
            rows = b.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([n[0] for n in near], pa.int32()), pa.array([n[2] for n in near], pa.string())], names=[*names, "ancestor_pre", "ancestor_path"])

    return both.repartition("rec_id").sortWithinPartitions("rec_id", "pre", "_opens").mapInArrow(run, schema)


def elements(records: DataFrame, fields: bool = False) -> DataFrame:
    """The node table of all objects that are array elements, of the version that holds of each record, written once."""
    return materialize(hold_nodes(shred(records, ("object",), elements_only=True, fields=fields), records), "nodes")


def objects(records: DataFrame) -> DataFrame:
    """p6: each object that is an array element, with its parent object and, for a tool result, its call."""
    nodes = elements(records)
    linked = link_calls(contain(nodes, nodes.select("rec_id", "pre", "post", "uuid", "session_id", "node_path", "result_key", "call_key", "rec_ts")))
    return linked.select("uuid", F.col("node_path").alias("obj_path"), F.coalesce("ancestor_path", F.lit("")).alias("parent_path"), "call_uuid")


def typed_nodes(records: DataFrame, node_type: str | None) -> DataFrame:
    """The node table of one type (NULL: objects without a type): numbers, scalar members as JSON, and the closest enclosing object of any type."""
    nodes = elements(records, fields=True)
    own = nodes.where(F.col("node_type").eqNullSafe(F.lit(node_type)))
    linked = contain(nodes, own.select("rec_id", "pre", "post", "depth", "uuid", "node_path", "value"))
    return linked.select("uuid", "pre", "post", "depth", F.col("node_path").alias("obj_path"), F.col("ancestor_pre").alias("parent_pre"), F.coalesce("ancestor_path", F.lit("")).alias("parent_path"), F.col("value").alias("fields"))
