"""URL filters by a tree of path templates.

Rules on host and path decide first, and what they decide is the evidence for the rest. For every host a tree of templates is
grown, level by level: a path segment that enough of the host's pages share stays as it is, all others of a node are one
wildcard. Siblings whose labels and whose continuations are statistically alike are merged into one branch, with
all that grows from it. A template is rejected if the labelled pages it holds are nearly all blocked, where their share
is smoothed by that of its siblings, theirs by that of their parent's siblings and so on, up to the corpus's share. So
every labelled page counts once.

A node has at most ``SHARE`` named children, however many segments its pages have, so no group of rows meets in one place: counts
are combined before each shuffle, and only children, never pages, are gathered by node.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpustag.llm.storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels of a tree; what is deeper is one template, ``/**``.
DEPTH = 6
#: A segment stays as it is where so many pages have it, and at least one in ``SHARE`` of its host's.
MIN_PAGES, SHARE = 8, 256
#: What is known without a template's own pages counts as so many labelled ones.
STRENGTH = 4.0
#: Templates are rejected from this purity on. Hosts start at the corpus's share of blocked pages, at most at ``NEUTRAL``.
LIMIT, NEUTRAL = 0.8, 0.5
#: Branches whose shares differ by at most this are alike, however many pages show it.
ALIKE = 0.02
#: What chi-square exceeds with a chance of 1 %, by degrees of freedom 1 to 5.
CHI_SQUARE = (6.635, 9.210, 11.345, 13.277, 15.086)
#: Kinds of what follows a segment: nothing, an empty segment, digits, letters, all else.
KINDS = 5
#: Names shown of a merged branch.
SHOWN = 8


@dataclass(frozen=True)
class Rule:
    """Pages of ``host`` and its subdomains whose path begins with ``path`` are allowed or blocked."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or number sign, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(_behind(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or number sign; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (``size``, ``verdict``, ``text``); of equally long ones a blocking one."""
    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    each = [F.when(fits(r), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("text")))
            for r in rules]
    if not each:
        return F.lit(None).cast("struct<size:int,verdict:string,text:string>")
    return F.array_max(F.array_compact(F.array(*each)))


def alike(one: list[int], two: list[int]) -> bool:
    """Whether two rows of counts over the same kinds may come from one distribution: chi-square at 1 %, or shares within ``ALIKE``."""
    kinds = [(a, b) for a, b in zip(one, two) if a + b]
    n, m = sum(one), sum(two)
    if not n or not m or len(kinds) < 2:
        return True
    if sum(abs(a / n - b / m) for a, b in kinds) / 2 <= ALIKE:
        return True
    total = n + m
    chi = sum((a - n * (a + b) / total) ** 2 / (n * (a + b) / total) + (b - m * (a + b) / total) ** 2 / (m * (a + b) / total) for a, b in kinds)
    return chi <= CHI_SQUARE[len(kinds) - 2]


def merged(children: list[dict]) -> list[list[dict]]:
    """Siblings in branches, the largest first. A child joins the first branch whose labels and continuations are like its own;
    children without labels are merged only with each other, as nothing speaks for or against them."""
    branches: list[dict] = []
    for child in sorted(children, key=lambda c: (-c["n"], c["segment"] is not None, c["segment"] or "")):
        labels, kinds = [child["blocked"], child["allowed"]], list(child["kinds"])
        for b in branches:
            if any(labels) == any(b["labels"]) and alike(labels, b["labels"]) and alike(kinds, b["kinds"]):
                b["members"].append(child)
                b["labels"] = [x + y for x, y in zip(b["labels"], labels)]
                b["kinds"] = [x + y for x, y in zip(b["kinds"], kinds)]
                break
        else:
            branches.append({"labels": labels, "kinds": kinds, "members": [child]})
    return [b["members"] for b in branches]


def smoothed(blocked: int, allowed: int, prior: float) -> float:
    """The share of blocked pages among the labelled, with ``STRENGTH`` more pages of the share ``prior``."""
    return (blocked + STRENGTH * prior) / (blocked + allowed + STRENGTH)


def branch_name(segments: list[str | None]) -> str:
    """A branch in a template: its segment, ``*`` for all that are not named, or several in brackets."""
    escaped = {c: "%%%02X" % ord(c) for c in "%*()|+"}
    names = sorted("*" if s is None else s.translate(str.maketrans(escaped)) for s in segments)
    if len(names) == 1:
        return names[0]
    more = f"+{len(names) - SHOWN}" if len(names) > SHOWN else ""
    return "(" + "|".join(names[:SHOWN]) + more + ")"


_GROWN = "host string, node string, names array<string>, goes array<struct<node:string,prior:double,purity:double>>"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their children in; for each node its named segments, and where they and (last) all others go, out."""
    place = pa.struct([("node", pa.string()), ("prior", pa.float64()), ("purity", pa.float64())])
    schema = pa.schema([("host", pa.string()), ("node", pa.string()), ("names", pa.list_(pa.string())), ("goes", pa.list_(place))])
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            all_blocked, all_allowed = (sum(c[k] for c in row["children"]) for k in ("blocked", "allowed"))
            names, goes, other = [], [], None
            for branch in merged(row["children"]):
                blocked, allowed = (sum(c[k] for c in branch) for k in ("blocked", "allowed"))
                prior = smoothed(all_blocked - blocked, all_allowed - allowed, row["prior"])
                to = {"node": row["node"] + "/" + branch_name([c["segment"] for c in branch]), "prior": prior,
                      "purity": smoothed(blocked, allowed, prior)}
                for child in branch:
                    if child["segment"] is None:
                        other = to
                    else:
                        names.append(child["segment"])
                        goes.append(to)
            yield pa.RecordBatch.from_pylist(
                [{"host": row["host"], "node": row["node"], "names": names, "goes": [*goes, other]}], schema)


def _kind_of(segment: Column) -> Column:
    """0 to 4: nothing, empty, digits, letters, all else."""
    return (F.when(segment.isNull(), 0).when(segment == "", 1).when(segment.rlike(r"^[0-9]+$"), 2)
            .when(segment.rlike(r"^[A-Za-z\x{80}-\x{10FFFF}]+$"), 3).otherwise(4))


def _children(rows: DataFrame, level: int) -> DataFrame:
    """Nodes (``host``, ``node``, ``prior``) with their children: named segments, and one without a name for all others."""
    segment, kind = F.get("segments", F.lit(level)), _kind_of(F.get("segments", F.lit(level + 1)))
    one = [F.sum((kind == k).cast("bigint")).alias(f"k{k}") for k in range(KINDS)]
    counted = rows.filter(F.size("segments") > level).groupBy("host", "node", segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"), F.count_if("allowed").alias("allowed"),
        F.max("pages").alias("pages"), F.max("prior").alias("prior"), *one)
    named = (F.col("n") >= MIN_PAGES) & (F.col("n") * SHARE >= F.col("pages"))
    sums = [F.sum(c).alias(c) for c in ["n", "blocked", "allowed", *[f"k{k}" for k in range(KINDS)]]]
    few = counted.groupBy("host", "node", F.when(named, F.col("segment")).alias("segment")).agg(F.max("prior").alias("prior"), *sums)
    child = F.struct("segment", "n", "blocked", "allowed", F.array(*[F.col(f"k{k}") for k in range(KINDS)]).alias("kinds"))
    return few.groupBy("host", "node").agg(F.max("prior").alias("prior"), F.collect_list(child).alias("children"))


def judged(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: tuple[Rule, ...] = RULES,
           label_column: str | None = None) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every page.

    The longest fitting rule decides; elsewhere the page's template does. Labelled pages are those that a rule decides, and those
    where ``label_column`` says ``allow`` or ``block``; rules go before labels. ``rules`` is a short list, held in the plan.

    A null url, or one without ``://``, has an empty host and path and no rule; all such pages are one host. Repeated urls and
    ids count each. A path's case is kept; an empty segment is a segment. Other columns are ignored, an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    url = F.col(f"`{url_column}`")
    label = F.lit(None).cast("string") if label_column is None else F.col(f"`{label_column}`").cast("string")
    read = pages.select(F.col(f"`{id_column}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), label.alias("label"))
    decided = read.withColumn("hit", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("hit.verdict", "label")
    base = scratch.keep(decided.select(
        "page_id", "host", "path", F.col("hit.text").alias("rule"), F.col("hit.verdict").alias("ruled"),
        F.coalesce(verdict == "block", F.lit(False)).alias("blocked"), F.coalesce(verdict == "allow", F.lit(False)).alias("allowed"),
        # a path is empty or begins with a slash
        F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
            F.split(F.substring("path", 2, 1 << 30), "/", DEPTH + 1)).alias("segments")), "pages")

    hosts = scratch.keep(base.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("blocked").alias("_blocked"), F.count_if("allowed").alias("_allowed")), "hosts")
    sums = hosts.agg(F.sum("_blocked").alias("b"), F.sum("_allowed").alias("a")).first()
    share = ((sums["b"] or 0) + NEUTRAL) / ((sums["b"] or 0) + (sums["a"] or 0) + 1)
    start = min(share, NEUTRAL)
    # tables of hosts and nodes are written first: their size is known when Spark chooses how to join them, and skew is split
    rows = base.join(hosts.select(
        "host", "pages", F.lit("").alias("node"), F.lit(start).alias("prior"),
        ((F.col("_blocked") + F.lit(STRENGTH * start)) / (F.col("_blocked") + F.col("_allowed") + STRENGTH)).alias("purity")), "host")
    kept = None
    for level in range(DEPTH):
        rows = scratch.keep(rows, f"level_{level}")
        scratch.drop(kept or "pages")
        kept = f"level_{level}"
        grown = scratch.keep(_children(rows, level).mapInArrow(_grow, _GROWN), f"grown_{level}")
        if grown.isEmpty():
            break
        at = F.array_position("_names", F.get("segments", F.lit(level))).cast("int")
        to = F.when(F.size("segments") > level, F.get("_goes", F.when(at > 0, at - 1).otherwise(F.size("_names"))))
        rows = rows.withColumn("_here", F.struct("node", "prior", "purity")).join(
            grown.withColumnsRenamed({"names": "_names", "goes": "_goes"}), ["host", "node"], "left").select(
            *[c for c in rows.columns if c not in ("node", "prior", "purity")], F.coalesce(to, F.col("_here")).alias("_to")).select(
            "*", "_to.*").drop("_to")
    template = F.when(F.size("segments") > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= LIMIT, "block").otherwise("allow"))
    return rows.select(F.col("page_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), template.alias("template"), "purity")
