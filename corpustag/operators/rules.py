"""The rule set as a table: validate, import, number, select, apply groups.

A rule frame has the columns of ``RULE_SCHEMA`` plus ``rule_no``, its position in
the rule file, which fixes the order of tags and matched rules.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import rule_id, trim_ws
from ..schema import CONFIG_SCHEMA, RULE_SCHEMA, RULE_TYPES, SCOPES
from .scale import lookup_join, numbered_within, running_sum_within

# Payloads whose rules are numbered together.
PAYLOADS_PER_SLICE = 1_024

_TAG_ALPHABET = r"^[a-zA-Z0-9\-_/]+\z"


def explode_rules(configs: DataFrame) -> DataFrame:
    """Rules of ``CONFIG_SCHEMA`` rows, one row each, numbered by position."""
    return configs.select(F.posexplode("rules").alias("rule_no", "rule")).select("rule_no", "rule.*")


def explode_groups(configs: DataFrame) -> DataFrame:
    """Groups of ``CONFIG_SCHEMA`` rows as ``(name, description, additionalTags, enabled)``."""
    return configs.select(F.explode("groups").alias("name", "group")).select("name", "group.*")


def is_enabled() -> Column:
    """A rule is on unless it says it is off."""
    return F.coalesce(F.col("enabled"), F.lit(True))


def _problem(condition: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(message))


def rule_errors() -> Column:
    """What is wrong with a rule, as an array (empty if nothing is)."""
    lowest, highest = F.col("filters.sentiment.min"), F.col("filters.sentiment.max")
    scope = F.col("filters.sentiment.scope")
    blank_match = F.col("match").isNull() | (trim_ws(F.col("match")) == "")

    def outside(bound: Column) -> Column:
        return F.isnan(bound) | (bound < -1) | (bound > 1)

    return F.array_compact(F.array(
        _problem(F.col("type").isNull(), "type is missing"),
        _problem(~F.col("type").isin(RULE_TYPES), "type is unknown"),
        _problem(blank_match, "match is blank"),
        _problem((F.col("type") == "pattern") & ~blank_match
                 & (trim_ws(F.col("match")) != F.col("match")), "pattern has a blank element"),
        _problem(F.col("tags").isNull() | (F.size("tags") == 0), "no tags"),
        _problem((F.col("type") == "keyword") & F.col("lemma") & F.col("stem"), "lemma and stem"),
        _problem(outside(lowest), "sentiment min outside [-1, 1]"),
        _problem(outside(highest), "sentiment max outside [-1, 1]"),
        _problem(lowest > highest, "sentiment min above max"),
        _problem(~scope.isin(SCOPES), "sentiment scope is unknown"),
    ))


def rule_warnings() -> Column:
    """Tags no reader will find again, so that every run would add them anew."""
    odd = F.filter("tags", lambda t: ~t.rlike(_TAG_ALPHABET))
    return F.transform(odd, lambda t: F.concat(F.lit("tag outside the alphabet: "), t))


def check_rules(rules: DataFrame) -> DataFrame:
    """Drop empty tags, then attach ``errors`` and ``warnings``."""
    return rules.withColumn("tags", F.filter("tags", lambda t: t != "")).withColumn(
        "errors", rule_errors()).withColumn("warnings", F.coalesce(rule_warnings(), F.array()))


def valid_rules(rules: DataFrame) -> DataFrame:
    return check_rules(rules).where(F.size("errors") == 0).drop("errors", "warnings")


def quarantined_rules(rules: DataFrame) -> DataFrame:
    return check_rules(rules).where(F.size("errors") > 0)


def select_rules(
    rules: DataFrame, enabled: bool = False, disabled: bool = False, group: str | None = None,
) -> DataFrame:
    """By state (``enabled`` wins over ``disabled``) and by group."""
    if enabled:
        rules = rules.where(is_enabled())
    elif disabled:
        rules = rules.where(~is_enabled())
    return rules.where(F.array_contains("groups", group)) if group else rules


def with_unique_ids(rules: DataFrame, taken: DataFrame | None = None, rows_per_slice: int = 4_096) -> DataFrame:
    """F9 + R2: ids from type and match; repeats get ``-2``, ``-3`` … in order of ``rule_no``.

    A number whose id is already in ``taken(id)``, or is the base id of another new rule,
    is passed over. Every arrival claims the next free number of its base.

    A base that holds many rules is numbered in slices of its order, and so is the search for free numbers: the n-th free
    number is n plus the used numbers that have fewer than n free ones below them, a running sum over arrivals and used
    numbers merged in one order.
    """
    based = rules.withColumn("_base", rule_id(F.col("type"), F.col("match")))
    numbered = numbered_within(
        based, ["_base"], ["rule_no"], F.floor(F.col("rule_no") / rows_per_slice), "_arrival")

    # Ids in use that look like <base>-<number>, for bases that occur here.
    used = based.select(F.col("_base").alias("id")).distinct().withColumn("_new", F.lit(True))
    if taken is not None:
        used = used.unionByName(taken.select("id", F.lit(False).alias("_new")).distinct())
    bases = based.select("_base").distinct()
    suffixed = used.where(F.col("id").rlike(r"-[1-9][0-9]*\z")).select(
        F.regexp_replace("id", r"-[0-9]+\z", "").alias("_base"),
        F.regexp_extract("id", r"-([0-9]+)\z", 1).try_cast("long").alias("_number"),
    ).where("_number >= 2").unionByName(
        used.where(~F.col("_new")).select(F.col("id").alias("_base"), F.lit(1).cast("long").alias("_number"))
    ).join(bases, "_base", "left_semi").distinct()
    ranked = numbered_within(
        suffixed, ["_base"], ["_number"], F.floor(F.col("_number") / rows_per_slice), "_rank")
    # Used numbers run in stretches with as many free numbers below them; a stretch is one row.
    stretches = ranked.groupBy("_base", (F.col("_number") - F.col("_rank")).cast("long").alias("_key")).agg(
        F.count("*").alias("_length"))

    kept = [c for c in numbered.columns if c not in ("_base", "_arrival")]
    rule = F.struct(*[F.col(c) for c in kept])
    rows = numbered.select("_base", F.col("_arrival").cast("long").alias("_key"), F.lit(0).cast("long").alias("_length"), rule.alias("_rule"))
    rows = rows.unionByName(stretches, allowMissingColumns=True)
    # an arrival stands before a stretch of its own key, which does not move it
    placed = running_sum_within(
        rows, ["_base"], [F.col("_key"), F.col("_rule").isNull()], F.floor(F.col("_key") / rows_per_slice), "_length", "_used")
    n = F.col("_key") + F.col("_used")
    return placed.where("_rule is not null").withColumn("_id", F.when(n == 1, F.col("_base")).otherwise(
        F.concat("_base", F.lit("-"), n.cast("string")))).select("_rule.*", "_id").drop("id").withColumnRenamed("_id", "id").select(
        *kept, *([] if "id" in kept else ["id"]))


def _import_schema(schema: T.StructType) -> T.StructType:
    """The schema with sentiment bounds read as text, so that bad ones can be told apart."""
    text = schema.json().replace('"name":"min","nullable":true,"type":"double"', '"name":"min","nullable":true,"type":"string"')
    text = text.replace('"name":"max","nullable":true,"type":"double"', '"name":"max","nullable":true,"type":"string"')
    return T.StructType.fromJson(json.loads(text))


def import_rules(
    payloads: DataFrame, taken: DataFrame | None = None, first_no: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, quarantine and groups out of ``payloads(seq, json)``.

    A payload is a whole configuration or one bare rule. Rules are numbered from ``first_no`` on in the order of payloads and of
    rules within them, bad ones included. Imported rules get fresh ids,
    a new ``created`` stamp and no ``modified``. A group named twice keeps the later
    payload's definition.
    """
    # the payload's place in the order decides a rule's, so rules are numbered before any is dropped
    parsed = payloads.select(
        "seq", F.from_json("json", _import_schema(CONFIG_SCHEMA)).alias("config"),
        F.from_json("json", _import_schema(RULE_SCHEMA)).alias("bare"))
    listed = numbered_within(
        parsed.select("seq", F.posexplode(F.coalesce("config.rules", F.array("bare"))).alias("pos", "rule")),
        [], ["seq", "pos"], F.floor(F.col("seq") / PAYLOADS_PER_SLICE), "rule_no",
    ).select((F.col("rule_no").cast("long") - 1 + first_no).alias("rule_no"), "rule.*")
    # A bound that is no number becomes NaN, which the checks reject.
    sentiment = F.col("filters.sentiment")
    bounds = {side: F.when(sentiment[side].isNotNull(), F.coalesce(
        sentiment[side].try_cast("double"), F.lit(float("nan")))) for side in ("min", "max")}
    rules = listed.withColumn("filters", F.when(F.col("filters").isNotNull(), F.struct(
        F.col("filters.pos").alias("pos"), F.col("filters.requireEntity").alias("requireEntity"),
        F.when(sentiment.isNotNull(), F.struct(
            bounds["min"].alias("min"), bounds["max"].alias("max"),
            sentiment["scope"].alias("scope"))).alias("sentiment"))))
    checked = check_rules(rules)
    good = with_unique_ids(
        checked.where(F.size("errors") == 0)
        .withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .withColumn("modified", F.lit(None).cast("string")), taken)
    bad = checked.where(F.size("errors") > 0)
    groups = parsed.select("seq", F.explode("config.groups").alias("name", "group"))
    latest = groups.groupBy("name").agg(F.max_by("group", "seq").alias("group")).select("name", "group.*")
    return good, bad, latest


def merge_config(
    rules: DataFrame, groups: DataFrame, payloads: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rules and groups with those of ``payloads(seq, json)`` taken in: (rules, groups, report).

    Imported rules follow the stored ones under free ids. An imported group replaces the stored one of its name; the last payload
    that names a group decides. ``report`` has a row for every imported rule and group: ``kind`` (rule or group), ``name`` (the id,
    of skipped rules the number, of groups the name), ``outcome`` (imported, skipped; added, overwritten, unchanged) and ``errors``.
    """
    last = rules.agg(F.max("rule_no")).first()[0]
    good, bad, named = import_rules(payloads, rules.select("id"), 0 if last is None else last + 1)
    fields = [f for f in groups.columns if f != "name"]
    stored, fresh = F.struct(*[F.col(f"stored.{f}") for f in fields]), F.struct(*[F.col(f"fresh.{f}") for f in fields])
    both = groups.alias("stored").join(named.alias("fresh"), F.col("stored.name") == F.col("fresh.name"), "full_outer").select(
        F.coalesce("stored.name", "fresh.name").alias("name"), F.when(F.col("stored.name").isNotNull(), stored).alias("_stored"),
        F.when(F.col("fresh.name").isNotNull(), fresh).alias("_fresh"))
    merged = both.select("name", F.coalesce("_fresh", "_stored").alias("_group")).select("name", "_group.*")
    outcome = F.when(F.col("_stored").isNull(), "added").when(F.col("_stored").eqNullSafe(F.col("_fresh")), "unchanged").otherwise("overwritten")
    nothing = F.array().cast("array<string>")
    report = (
        good.select(F.lit("rule").alias("kind"), F.col("id").alias("name"), F.lit("imported").alias("outcome"), nothing.alias("errors"))
        .unionByName(bad.select(F.lit("rule").alias("kind"), F.col("rule_no").cast("string").alias("name"), F.lit("skipped").alias("outcome"), "errors"))
        .unionByName(both.where("_fresh is not null").select(F.lit("group").alias("kind"), "name", outcome.alias("outcome"), nothing.alias("errors"))))
    everything = rules.unionByName(good.select(*[c for c in good.columns if c in rules.columns]), allowMissingColumns=True)
    return everything, merged, report


def import_counts(report: DataFrame) -> DataFrame:
    """How many rules and groups had each outcome."""
    return report.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def apply_groups(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Add the tags of a rule's groups; any disabled group turns the rule off."""
    member = rules.select("rule_no", F.explode("groups").alias("name"))
    table = groups.select("name", "additionalTags", F.coalesce("enabled", F.lit(True)).alias("_on"))
    effects = lookup_join(member, table, ["name"]).groupBy("rule_no").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(
            F.coalesce("additionalTags", F.array().cast("array<string>")))))).alias("_extra"),
        F.min("_on").alias("_all_on"))
    return rules.join(effects, "rule_no", "left").withColumn(
        "tags", F.when(F.col("_extra").isNotNull(), F.array_union("tags", "_extra")).otherwise(F.col("tags"))
    ).withColumn("enabled", is_enabled() & F.coalesce("_all_on", F.lit(True))).drop("_extra", "_all_on")


def active_rules(
    rules: DataFrame, groups: DataFrame | None = None, honor_groups: bool = False,
) -> DataFrame:
    """The rules a run uses: valid, enabled, and with group effects if asked for."""
    rules = valid_rules(rules)
    if honor_groups and groups is not None:
        rules = apply_groups(rules, groups)
    return rules.where(is_enabled())
