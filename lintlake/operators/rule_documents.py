"""Rule documents as VARIANT: taint rules of scanners normalized, nested pattern entries walked to any depth, and normalized rules validated.

A document is one row; its lists are exploded level by level until nothing is nested any more, each level written, so no
schema has to know how deep a rule goes. Order is kept by each entry's place (the indexes on the way to it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import written

# Languages, the severities of scanners, families by weakness, hints of families in order, and the names of every list of values that a normalized rule may have.
LANGUAGES = ("python", "javascript", "java", "php")
SEVERITY = {"ERROR": "CRITICAL", "WARNING": "HIGH", "INFO": "MEDIUM", "LOW": "LOW"}
FAMILY_BY_CWE = {"CWE-22": "PATH_TRAVERSAL", "CWE-77": "COMMAND_INJECTION", "CWE-78": "COMMAND_INJECTION", "CWE-79": "XSS", "CWE-89": "SQL_INJECTION", "CWE-502": "INSECURE_DESERIALIZATION", "CWE-918": "SSRF"}
HINTS = {"command": "COMMAND_INJECTION", "deserial": "INSECURE_DESERIALIZATION", "path": "PATH_TRAVERSAL", "sql": "SQL_INJECTION", "ssrf": "SSRF", "template": "SSTI", "xss": "XSS"}
FAMILIES = (
    "SQL_INJECTION", "COMMAND_INJECTION", "CODE_INJECTION", "PATH_TRAVERSAL", "XPATH_INJECTION", "LDAP_INJECTION", "XXE", "SSRF", "XSS", "NOSQL_INJECTION", "IDOR", "SSTI", "INSECURE_DESERIALIZATION", "MASS_ASSIGNMENT", "OPEN_REDIRECT",
)
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
PATTERN_MODES = ("pattern", "pattern-regex", "literal")
MODIFIERS = ("focus-metavariable", "metavariable-regex", "metavariable-pattern", "metavariable-comparison", "pattern-not", "pattern-not-regex", "pattern-not-inside", "pattern-where-python", "pattern-where-java")
PROFILES = {
    "python-rule-workbench-v1": ("COMMAND_INJECTION", "PATH_TRAVERSAL", "INSECURE_DESERIALIZATION"), "python-reviewed-core4-v1": ("COMMAND_INJECTION", "PATH_TRAVERSAL", "INSECURE_DESERIALIZATION", "SQL_INJECTION"), "python-reviewed-ssrf-v1": ("SSRF",),
}
CALL_HEAD = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\("
CALL_LIKE = r"^\s*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\s*\("
CWE, OWASP = r"^CWE-\d+$", r"^A\d{1,2}:\d{4}$"
ROLES = {"source": "pattern-sources", "sink": "pattern-sinks", "sanitizer": "pattern-sanitizers"}
GROUPS = ("pattern-either", "patterns")
TYPE_NAMES = {"null": "NoneType", "boolean": "bool", "list": "list", "whole": "int", "number": "float"}


def get(v: Column, *names: str) -> Column:
    """The value at a path of names; null where there is none."""
    return F.try_variant_get(v, "$" + "".join(f'["{n}"]' for n in names), "variant")


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use of x, with x worked out once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _kind(schema: Column) -> Column:
    return (
        F.when(schema.isNull() | (schema == "VOID"), "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema.startswith("ARRAY"), "list").when(schema.startswith("OBJECT"), "map")
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | schema.rlike(r"^DECIMAL\(\d+,0\)$"), "whole").otherwise("number")
    )


def kind(v: Column) -> Column:
    """null, string, boolean, whole, number, list or map."""
    return let(F.schema_of_variant(v), _kind)


def text(v: Column) -> Column:
    """A text value; null for values of other kinds."""
    return let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def items(v: Column) -> Column:
    """A list's values; none for values of other kinds."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def listed(v: Column) -> Column:
    """A list as it is, null as none, any other value as a list of one."""
    return let(v, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(kind(x) == "null", F.array().cast("array<variant>")).otherwise(F.array(x))))


def names(v: Column) -> Column:
    """The names in a mapping, in order."""
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def truth(v: Column) -> Column:
    """Whether a value counts as true: neither null, false, zero nor empty."""

    def of(x: Column) -> Column:
        return let(F.struct(x.alias("v"), kind(x).alias("k"), F.try_variant_get(x, "$", "string").alias("said")), lambda s: (
            F.when(s["k"] == "boolean", s["said"] == "true").when(s["k"] == "string", s["said"] != "").when(s["k"].isin("whole", "number"), F.try_variant_get(s["v"], "$", "double") != 0).when(s["k"] == "list", s["said"] != "[]").when(s["k"] == "map", s["said"] != "{}").otherwise(F.lit(False))
        ))

    return let(v, of)


def filled(v: Column) -> Column:
    """Whether a value is text with something in it."""
    return F.coalesce(F.trim(text(v)) != "", F.lit(False))


def focus(v: Column) -> Column:
    return F.nullif(F.trim(text(get(v, "focus-metavariable"))), F.lit(""))


def only_modifies(v: Column) -> Column:
    return F.coalesce(F.size(F.array_except(names(v), F.array(*[F.lit(m) for m in MODIFIERS]))) == 0, F.lit(False))


def _own_patterns(item: Column, given: Column) -> Column:
    """The patterns that an entry states itself, in order."""
    side, exact = truth(get(item, "by-side-effect")), get(item, "exact")
    direct = text(get(item, "pattern"))
    guess = F.when(F.array_contains(names(item), "exact"), truth(exact)).otherwise(F.trim(direct).rlike(CALL_HEAD))
    row = lambda n, pattern, mode, sure, by: let(pattern, lambda p: F.when(p.isNotNull(), F.struct(F.lit(n).alias("n"), p.alias("pattern"), F.lit(mode).alias("pattern_mode"), sure.alias("exact"), by.alias("by_side_effect"), given.alias("focus_metavariable"))))
    no = F.lit(False)
    plain = row(0, text(item), "literal", no, no)
    return F.array_compact(F.array(plain, row(0, direct, "pattern", guess, side), row(1, text(get(item, "pattern-inside")), "pattern", no, side), row(2, text(get(item, "pattern-regex")), "pattern-regex", truth(exact), side)))


def pattern_entries(rules: DataFrame, doc: str = "rule") -> tuple[DataFrame, DataFrame]:
    """Patterns (rule_id, role, position, pattern, pattern_mode, exact, by_side_effect, focus_metavariable) and notes (rule_id, role, position, note) of taint rules.

    rules: rule_id, and the document as VARIANT. Entries are text, or mappings with pattern, pattern-inside, pattern-regex
    and nested groups (pattern-either, patterns). The focus of a group's last child that names one goes to all its
    children. Children that only modify others are left out. Equal patterns of a role count once. Entries of other kinds,
    groups that are no lists and mappings without any pattern leave a note.
    """
    role = F.array(*[F.struct(F.lit(r).alias("role"), listed(get(F.col(doc), key)).alias("items")) for r, key in ROLES.items()])
    level = rules.select("rule_id", F.explode(role).alias("r")).select("rule_id", "r.role", F.posexplode("r.items").alias("p", "item")).select("rule_id", "role", F.array("p").alias("at"), "item", F.lit(None).cast("string").alias("focus"))
    found, notes = None, None
    while True:
        level = written(level, "rule-entries")
        if level.isEmpty():
            break
        item = F.col("item")
        at = level.withColumn("_kind", kind(item)).withColumn("_focus", F.coalesce(focus(item), "focus")).withColumn("_own", _own_patterns(item, F.when(F.col("_kind") == "string", F.col("focus")).otherwise(F.col("_focus"))))
        got = at.select("rule_id", "role", "at", F.explode("_own").alias("x")).select("rule_id", "role", F.concat("at", F.array("x.n")).alias("at"), "x.pattern", "x.pattern_mode", "x.exact", "x.by_side_effect", "x.focus_metavariable")
        groups = [get(item, g) for g in GROUPS]
        nested = F.array(*[F.struct(F.lit(3 + i).alias("n"), items(g).alias("children"), F.coalesce(F.aggregate(items(g), F.lit(None).cast("string"), lambda acc, c: F.coalesce(focus(c), acc)), "_focus").alias("focus")) for i, g in enumerate(groups)])
        has_group = F.lit(False)
        for g in groups:
            has_group = has_group | (kind(g) != "null")
        note = F.array_compact(F.array(
            F.when(~F.col("_kind").isin("string", "map"), F.concat(F.lit("Skipped "), F.col("role"), F.lit(" entry with unsupported type: "), F.element_at(F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p]), F.col("_kind")))),
            *[F.when(~kind(g).isin("null", "list"), F.concat(F.lit("Skipped "), F.col("role"), F.lit(f" nested group '{name}' because it is not a list"))) for name, g in zip(GROUPS, groups, strict=True)],
            F.when((F.col("_kind") == "map") & (F.size("_own") == 0) & ~has_group & ~only_modifies(item), F.concat(F.lit("Skipped "), F.col("role"), F.lit(" entry without reviewable pattern fields: "), F.array_join(names(item), ", "))),
        ))
        said = at.select("rule_id", "role", "at", F.posexplode(note).alias("_n", "note")).select("rule_id", "role", F.concat("at", F.array(F.col("_n") + 5)).alias("at"), "note")
        found = got if found is None else found.unionByName(got)
        notes = said if notes is None else notes.unionByName(said)
        below = at.select("rule_id", "role", "at", F.explode(nested).alias("g")).select("rule_id", "role", "at", "g.n", "g.focus", F.posexplode("g.children").alias("i", "item"))
        level = below.filter(~only_modifies(F.col("item"))).select("rule_id", "role", F.concat("at", F.array("n", "i")).alias("at"), "item", "focus")
    if found is None:
        empty = rules.sparkSession.createDataFrame([], "rule_id string, role string, position int, pattern string, pattern_mode string, exact boolean, by_side_effect boolean, focus_metavariable string")
        return empty, rules.sparkSession.createDataFrame([], "rule_id string, role string, position int, note string")
    same = ["rule_id", "role", "pattern", "pattern_mode", "exact", "by_side_effect", "focus_metavariable"]
    once = found.groupBy(*same).agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("rule_id", "role").orderBy("at"))  # a rule's own entries
    return once.withColumn("position", place).drop("at"), notes.withColumn("position", place).drop("at")


def _strings(v: Column) -> Column:
    return F.filter(F.transform(listed(v), lambda x: F.trim(text(x))), lambda x: x.isNotNull() & (x != ""))


def _all(pattern: str, values: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, lambda x: F.regexp_extract_all(F.upper(x), F.lit(pattern), 0))))


def normalize_rules(rules: DataFrame, doc: str = "rule", language: str | None = None, family: str | None = None) -> DataFrame:
    """rule_id, title, language, family, severity, cwe, owasp, n_sources, n_sinks, n_sanitizers, skip_reason of scanner rules (rule_id and the document as VARIANT; rule_id tells rows apart, the rule's own id is source_rule_id).

    The first reason that applies is given: no mapping, not in taint mode, no supported language (or not the one asked
    for), no family by weakness, hint or override, no reviewable source or sink.
    """
    v = F.col(doc)
    patterns, _ = pattern_entries(rules, doc)
    counts = patterns.groupBy("rule_id").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}s") for r in ROLES])
    meta = F.when(kind(get(v, "metadata")) == "map", get(v, "metadata"))
    spoken = F.transform(listed(get(v, "languages")), lambda x: F.lower(F.trim(F.try_variant_get(x, "$", "string"))))
    known = F.filter(spoken, lambda x: x.isin(*LANGUAGES))
    tongue = F.when(F.array_contains(spoken, language.strip().lower()), language.strip().lower()) if language else F.get(known, F.lit(0))
    ids = _all(r"CWE-\d+", _strings(get(meta, "cwe")))
    by_id = F.get(F.filter(F.transform(ids, lambda x: F.element_at(F.create_map(*[F.lit(y) for p in FAMILY_BY_CWE.items() for y in p]), x)), lambda x: x.isNotNull()), F.lit(0))
    heap = F.lower(F.concat_ws(" ", F.try_variant_get(v, '$["id"]', "string"), F.try_variant_get(v, '$["message"]', "string"), F.to_json(meta)))
    hinted = F.coalesce(*[F.when(heap.contains(h), f) for h, f in HINTS.items()])
    own = F.coalesce(F.try_variant_get(v, '$["id"]', "string"), F.lit("<missing-id>"))
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for p in SEVERITY.items() for y in p]), F.upper(F.trim(text(get(v, "severity"))))), F.lit("MEDIUM"))
    out = rules.join(counts, "rule_id", "left").withColumns({
        "source_rule_id": own, "title": F.coalesce(F.try_variant_get(v, '$["message"]', "string"), own), "language": tongue, "family": F.lit(family) if family else F.coalesce(by_id, hinted), "severity": severity,
        "cwe": ids, "owasp": _all(r"A\d{1,2}:\d{4}", _strings(get(meta, "owasp"))), **{f"n_{r}s": F.coalesce(f"n_{r}s", F.lit(0)) for r in ROLES},
    })
    reason = (
        F.when(kind(v) != "map", "rule is not a mapping").when(F.coalesce(text(get(v, "mode")), F.lit("")) != "taint", "only taint-mode rules are supported").when(F.col("language").isNull(), "rule language is unsupported or filtered out")
        .when(F.col("family").isNull(), "could not infer family and no override was supplied").when((F.col("n_sources") == 0) | (F.col("n_sinks") == 0), "rule does not expose a reviewable taint source/sink subset")
    )
    return out.withColumn("skip_reason", reason).drop(doc)


def validate_rules(rules: DataFrame, doc: str = "rule", profile: str = "generic", schema_version: str | None = None) -> DataFrame:
    """rule_id, level, path, code of every issue of normalized rules (documents as VARIANT); none hides another. rule_id is the rule's own, or <missing-rule-id>."""
    # the parts and whether they are mappings are columns of their own, so that none is worked out once for each of its uses
    parts = ("taxonomy", "detection", "triage", "provenance", "notes")
    lists = {"taxonomy": ("cwe", "owasp"), "detection": ("source_patterns", "sink_patterns", "sanitizers"), "triage": ("knowledge_refs", "fp_hints", "remediation_notes")}
    rules = rules.select(F.col(doc), *[get(F.col(doc), n).alias(f"_{n}") for n in parts])
    rules = rules.select("*", *[(kind(F.col(f"_{n}")) == "map").alias(f"_is_{n}") for n in parts], *[get(F.col(f"_{n}"), x).alias(f"_{n}_{x}") for n, xs in lists.items() for x in xs])
    v = F.col(doc)
    issue = lambda on, level, path, code: F.when(on, F.struct(F.lit(level).alias("level"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code")))
    none = F.array().cast("array<struct<level:string,path:string,code:string>>")
    each = lambda xs, f: F.flatten(F.transform(xs, lambda x, i: F.array_compact(F.array(*f(x, i.cast("string"))))))
    at = lambda path, i, *rest: F.concat(F.lit(path + "["), i, F.lit("]" + "".join(rest)))
    single, many = [], []
    if schema_version is not None:
        single.append(issue(~F.coalesce(text(get(v, "schema_version")) == schema_version, F.lit(False)), "error", "schema_version", "invalid_rule_schema_version"))
    for n in ("rule_id", "title", "language", "family", "severity"):
        single.append(issue(~filled(get(v, n)), "error", n, "missing_required_field"))
    for n, allowed in (("language", LANGUAGES), ("family", FAMILIES), ("severity", SEVERITIES)):
        single.append(issue(~text(get(v, n)).isin(*allowed), "error", n, f"unsupported_{n}"))
    tax, det, tri, prov, notes = parts
    is_map = lambda part: F.col(f"_is_{part}")
    within = lambda part, n: get(F.col(f"_{part}"), n)
    single.append(issue(~is_map(tax), "error", "taxonomy", "invalid_taxonomy"))
    for n, form in (("cwe", CWE), ("owasp", OWASP)):
        x, path = F.col(f"_{tax}_{n}"), f"taxonomy.{n}"
        single.append(issue(is_map(tax) & (kind(x) != "list"), "error", path, "invalid_taxonomy_list"))
        many.append(F.when(is_map(tax), each(items(x), lambda e, i, path=path, form=form, n=n: [issue(~filled(e), "error", at(path, i), "invalid_taxonomy_value"), issue(filled(e) & ~F.upper(F.trim(text(e))).rlike(form), "warning", at(path, i), f"suspicious_{n}_format")])).otherwise(none))
    single += [issue(~is_map(det), "error", "detection", "invalid_detection"), issue(is_map(det) & ~filled(within(det, "match_mode")), "error", "detection.match_mode", "missing_match_mode")]
    for n in ("source_patterns", "sink_patterns", "sanitizers"):
        x, path = F.col(f"_{det}_{n}"), f"detection.{n}"
        single.append(issue(is_map(det) & (kind(x) != "list"), "error", path, "invalid_pattern_list"))
        if n != "sanitizers":
            single.append(issue(is_map(det) & (kind(x) == "list") & (F.size(items(x)) == 0), "error", path, "empty_pattern_list"))

        def entry(e: Column, i: Column, path: str = path) -> list[Column]:
            ok, pattern, mode = kind(e) == "map", text(get(e, "pattern")), text(get(e, "pattern_mode"))
            vague = (mode == "pattern") & pattern.rlike(CALL_LIKE) & (kind(get(e, "exact")) == "boolean") & ~truth(get(e, "exact"))
            return [
                issue(~ok, "error", at(path, i), "invalid_pattern_entry"), issue(ok & ~filled(get(e, "pattern")), "error", at(path, i, ".pattern"), "missing_pattern"),
                issue(ok & ~F.coalesce(mode.isin(*PATTERN_MODES), F.lit(False)), "error", at(path, i, ".pattern_mode"), "invalid_pattern_mode"), issue(ok & (kind(get(e, "exact")) != "boolean"), "error", at(path, i, ".exact"), "invalid_exact_flag"),
                issue(ok & (kind(get(e, "by_side_effect")) != "boolean"), "error", at(path, i, ".by_side_effect"), "invalid_by_side_effect_flag"),
                issue(ok & (kind(get(e, "focus_metavariable")) != "null") & ~filled(get(e, "focus_metavariable")), "error", at(path, i, ".focus_metavariable"), "invalid_focus_metavariable"),
                issue(ok & vague, "warning", at(path, i, ".exact"), "call_pattern_without_exact"),
            ]

        many.append(F.when(is_map(det), each(items(x), entry)).otherwise(none))
    single.append(issue(~is_map(tri), "error", "triage", "invalid_triage"))
    for n in ("knowledge_refs", "fp_hints", "remediation_notes"):
        x, path = F.col(f"_{tri}_{n}"), f"triage.{n}"
        single.append(issue(is_map(tri) & (kind(x) != "list"), "error", path, "invalid_triage_list"))
        many.append(F.when(is_map(tri), each(items(x), lambda e, i, path=path: [issue(~filled(e), "error", at(path, i), "invalid_triage_value")])).otherwise(none))
    single.append(issue(~is_map(prov), "error", "provenance", "invalid_provenance"))
    for n in ("source", "source_rule_id", "importer", "snapshot_version"):
        single.append(issue(is_map(prov) & ~filled(within(prov, n)), "error", f"provenance.{n}", "missing_required_field"))
    where = within(prov, "source_path")
    blank = (kind(where) == "null") | F.coalesce(text(where) == "", F.lit(False))
    single += [issue(is_map(prov) & blank, "warning", "provenance.source_path", "missing_source_path"), issue(is_map(prov) & ~blank & (kind(where) != "string"), "error", "provenance.source_path", "invalid_source_path")]
    single.append(issue(~kind(F.col(f"_{notes}")).isin("null", "list"), "warning", "notes", "invalid_notes"))
    many.append(each(items(F.col(f"_{notes}")), lambda e, i: [issue(~filled(e), "warning", at("notes", i), "invalid_note_value")]))
    if profile in PROFILES:
        single += [issue(text(get(v, "language")) != "python", "error", "language", "out_of_scope_language"), issue(~text(get(v, "family")).isin(*PROFILES[profile]), "error", "family", "out_of_scope_family")]
    named = F.when(filled(get(v, "rule_id")), F.trim(text(get(v, "rule_id")))).otherwise("<missing-rule-id>")
    return rules.select(named.alias("rule_id"), F.explode(F.concat(F.array_compact(F.array(*single)), *many)).alias("x")).select("rule_id", "x.*")
