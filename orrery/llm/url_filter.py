"""URL filters: explicit host and path rules, and a classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path, fitted on a
small table of labelled URLs (bounded by ``MAX_LABELLED`` rows) and scored in Arrow batches.

A rule is a host and the head of a path, written together (``example.org/en/``). It fits a URL
whose host is the rule's or a subdomain of it and whose path starts with the rule's; the longest
fitting rule decides. Everything without a fitting rule is left to the classifier.

Defined results: a null URL, or one without ``://``, has an empty host and path (no rule fits; the
classifier sees no n-gram, so its bias decides); null ids are kept; repeated rows are each judged.
With labels of one class only the classifier answers that class, without labels: allow. Further
columns of the pages are not read, so their names cannot clash.

``labelled_urls.csv`` is a small table of labelled URLs to start from. Prefixes, domains and paths
are the same for both labels, so only the names of its sites tell them apart.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.linear import Group, Logit, features, fit
from orrery.llm.words import Block, text_array

MAX_LABELLED = 10_000
GROUPS = (Group("host", 3), Group("host", 5), Group("path", 3))
THRESHOLD = 0.5
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {code: code + 32 for code in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    found = _HOST.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Rules:
    """Rules by host; a look-up tries each suffix of a host and each known length of a path's head."""

    def __init__(self, verdicts: Mapping[str, str]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in verdicts.items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for known in self.by_host.values():
            known.sort(key=lambda rule: -len(rule[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        at = 0
        while host and at >= 0:
            for head, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(head):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


def _sequences(hosts: list[str], paths: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    held = {}
    for name, texts in (("host", hosts), ("path", paths)):
        column = text_array(pa.array([f"^{t}$" if t else "" for t in texts], pa.large_string()))
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[: len(column) + 1]
        data = column.buffers()[2]
        block = Block(0, np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8), offsets)
        held[name] = block.code_points
    return held


def labelled(spark: SparkSession) -> DataFrame:
    """(url, allowed) of the table of labelled URLs that comes with the package."""
    with files(__package__).joinpath("labelled_urls.csv").open(encoding="utf-8", newline="") as lines:
        rows = [(row["url"], int(row["allowed"])) for row in csv.DictReader(lines)]
    return spark.createDataFrame(rows, "url string, allowed int")


def train(labelled: DataFrame, url_column: str = "url", label_column: str = "allowed") -> Logit:
    """A classifier from a small table of URLs labelled 1 (allow) or 0 (block)."""
    table = labelled.select(url_column, label_column).dropna().limit(MAX_LABELLED + 1).toArrow()
    if table.num_rows > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    rows = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    split = [parts(url) for url, _ in rows]
    found = _sequences([host for host, _ in split], [path for _, path in split])
    at_rows, at, shares = features(GROUPS, found)
    return fit(GROUPS, at_rows, at, shares, np.array([int(label > 0) for _, label in rows], dtype=np.int64))


def judge(pages: DataFrame, rules: Mapping[str, str], model: Logit, id_column: str = "page_id", url_column: str = "url",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, allow_probability) of every row."""
    kind = pages.schema[id_column].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast((dict(rules), model))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts, held = shared.value
        known = Rules(verdicts)
        for batch in batches:
            split = [parts(url) for url in batch.column(1).to_pylist()]
            hosts, paths = [host for host, _ in split], [path for _, path in split]
            probability = held.probability(_sequences(hosts, paths)) if split else np.zeros(0)
            fitting = [known.find(host, path) for host, path in split]
            verdict = [f[1] if f else ("allow" if p >= threshold else "block") for f, p in zip(fitting, probability, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array([f[0] if f else None for f in fitting], pa.string()), pa.array(verdict, pa.string()), pa.array(probability)],
                ["id", "host", "path", "rule", "verdict", "allow_probability"])

    found = pages.select(id_column, url_column).mapInArrow(
        look, f"id {kind}, host string, path string, rule string, verdict string, allow_probability double")
    return found.withColumnRenamed("id", id_column)


