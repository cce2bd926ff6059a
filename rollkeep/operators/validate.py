"""Validation, scoring and routing of extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.functions.values import CNIC, age_in_years, read_date, read_sex
from rollkeep.plans.schema import EVENT_DATES, Schema, value

SERIOUS = ("NO_FIELDS_EXTRACTED", "DOD_BEFORE_DOB", "MARRIAGE_BEFORE_BIRTH", "REGISTRATION_BEFORE_EVENT", "ISSUE_BEFORE_REGISTRATION", "AGE_INCONSISTENT", "DATE_IMPOSSIBLE", "DATE_IN_FUTURE", "DUPLICATE_ID_IN_ROW", "MISSING_REQUIRED", "OCR_EMPTY", "TEXT_EXTRACTION_FAILED")
PRIORS = {"manual": 1.0, "template": 1.0, "rule": 0.95, "llm": 0.85}
SERIOUS_COST, MINOR_COST, MOST_COST = 0.25, 0.08, 0.6
CEILING, REQUIRED_WEIGHT = 0.99, 3.0
OLDEST, AGE_SLACK = 130, 1
FLOOR, AUTO_APPROVE = 0.6, 1.0


def _issue(test: Column, field: str, flag: str | Column) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), (flag if isinstance(flag, Column) else F.lit(flag)).alias("flag")))


def _day(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def issues(schema: Schema, today: Column, certificate_type: str | None = None, floor: float = FLOOR) -> Column:
    """array<struct<field, flag>> of everything questionable about a row, in a fixed order.

    Values come from extraction and are in normal form already.

    The row has maps fields, printed and confidences, and the columns type_confidence,
    boundary_confidence, ocr_used and ocr_confidence.
    """
    v = {f.name: value("fields", f.name) for f in schema.fields}
    empty = F.size(F.filter(F.map_values("fields"), lambda x: F.trim(x) != "")) == 0
    found = [_issue(empty, "", "NO_FIELDS_EXTRACTED")]
    found += [_issue(~empty & v[f.name].isNull(), f.name, "MISSING_REQUIRED") for f in schema.fields if f.required]

    days = {f.name: _day(v[f.name]) for f in schema.fields if f.kind == "date"}
    for f in schema.by_kind("date"):
        unread = v[f.name].isNotNull() & days[f.name].isNull()
        found.append(_issue(unread, f.name, F.when(read_date(v[f.name], normal=True)["impossible"], "DATE_IMPOSSIBLE").otherwise("DATE_UNPARSEABLE")))
        found.append(_issue(days[f.name] > today, f.name, "DATE_IN_FUTURE"))
        found.append(_issue(days[f.name].isNotNull() & read_date(value("printed", f.name), normal=True)["ambiguous"], f.name, "DATE_AMBIGUOUS"))

    dated = lambda role: [f for f in schema.by_role(role) if f.name in days]
    for a, b, flag in (("birth_date", "death_date", "DOD_BEFORE_DOB"), ("birth_date", "marriage_date", "MARRIAGE_BEFORE_BIRTH")):
        found += [_issue(days[x.name] > days[y.name], y.name, flag) for y in dated(b) for x in dated(a)]
    events = [days[f.name] for r in EVENT_DATES for f in dated(r)]
    for r in dated("registration_date"):
        if events:
            found.append(_issue(F.coalesce(*events) > days[r.name], r.name, "REGISTRATION_BEFORE_EVENT"))
        found += [_issue(days[r.name] > days[i.name], i.name, "ISSUE_BEFORE_REGISTRATION") for i in dated("issue_date")]

    for f in schema.by_role("age"):
        age = F.floor(F.abs(v[f.name].try_cast("double"))) * F.signum(v[f.name].try_cast("double"))
        found.append(_issue(v[f.name].isNotNull() & age.isNull(), f.name, "VALUE_TRUNCATED"))
        impossible = (age < 0) | (age > OLDEST)
        born, died = ([days[x.name] for x in dated(r)] for r in ("birth_date", "death_date"))
        apart = F.abs(age_in_years(F.coalesce(*born), F.coalesce(*died)) - age) > AGE_SLACK if born and died else F.lit(False)
        found.append(_issue(impossible | apart, f.name, "AGE_INCONSISTENT"))

    earlier: list[Column] = []
    for f in schema.by_kind("id_number"):
        valid = v[f.name].rlike(CNIC)
        found.append(_issue(v[f.name].isNotNull() & ~valid, f.name, "CNIC_INVALID"))
        if earlier:
            found.append(_issue(valid & F.array_contains(F.filter(F.array(*earlier), lambda x: x.isNotNull()), v[f.name]), f.name, "DUPLICATE_ID_IN_ROW"))
        earlier.append(F.when(valid, v[f.name]))
    found += [_issue(v[f.name].isNotNull() & read_sex(v[f.name], normal=True).isNull(), f.name, "SEX_UNRECOGNISED") for f in schema.by_kind("sex")]

    if certificate_type == "OTHER":
        found.append(_issue(F.lit(True), "", "UNKNOWN_CERTIFICATE_TYPE"))
    found.append(_issue(F.col("type_confidence") < floor, "", "LOW_TYPE_CONFIDENCE"))
    found.append(_issue(F.col("boundary_confidence") < floor, "", "LOW_BOUNDARY_CONFIDENCE"))
    ocr = F.col("ocr_used") & F.col("ocr_confidence").isNotNull()
    found.append(_issue(ocr & (F.col("ocr_confidence") <= 0), "", "OCR_EMPTY"))
    found.append(_issue(ocr & (F.col("ocr_confidence") > 0) & (F.col("ocr_confidence") < floor * 100), "", "LOW_OCR_CONFIDENCE"))
    found += [_issue(v[f.name].isNotNull() & (F.try_element_at("confidences", F.lit(f.name)) < floor), f.name, "LOW_FIELD_CONFIDENCE") for f in schema.fields]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def flags(issue_list: Column) -> Column:
    """The different flags in the order in which they were first raised."""
    return F.array_distinct(F.transform(issue_list, lambda x: x["flag"]))


def score(schema: Schema, flag_list: Column) -> Column:
    """How much of a row was read, and how well; fields not read count as zero."""
    weights = {f.name: REQUIRED_WEIGHT if f.required else 1.0 for f in schema.fields}
    prior = lambda name: F.coalesce(*[F.when(F.try_element_at("methods", F.lit(name)) == m, p) for m, p in PRIORS.items()], F.lit(0.0))
    read = sum((F.when(value("fields", n).isNotNull(), w * F.coalesce(F.try_element_at("confidences", F.lit(n)), F.lit(0.0)) * prior(n)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    coverage = read / sum(weights.values())
    costs = F.aggregate(flag_list, F.lit(0.0), lambda s, x: s + F.when(x.isin(*SERIOUS), SERIOUS_COST).otherwise(MINOR_COST))
    whole = coverage * F.greatest("type_confidence", coverage) * (1.0 - F.least(F.lit(MOST_COST), costs))
    return F.round(F.least(F.lit(CEILING), F.greatest(F.lit(0.0), whole)) + 1e-9, 4)


def route(confidence: Column, flag_list: Column, floor: float = FLOOR, auto: float = AUTO_APPROVE) -> Column:
    return F.when(confidence < floor, "FAILED").when((F.size(flag_list) > 0) | (confidence < auto), "NEEDS_REVIEW").otherwise("AUTO_APPROVED")


def validated(rows: DataFrame, schema: Schema, today: Column, certificate_type: str | None = None, reader_flags: str | None = None) -> DataFrame:
    """Rows with issues, flags, score and status; reader flags join the flags after scoring."""
    checked = rows.withColumn("issues", issues(schema, today, certificate_type)).withColumn("flags", flags(F.col("issues")))
    scored = checked.withColumn("score", score(schema, F.col("flags"))).withColumn("status", route(F.col("score"), F.col("flags")))
    return scored.withColumn("flags", F.array_distinct(F.concat("flags", reader_flags))) if reader_flags else scored


def merged_layers(layers: Column, margin: float = 0.2) -> Column:
    """The value that stands after layers of struct(value, confidence) in order of priority.

    A later one replaces the one before only if it is surer by more than the margin.
    """
    return F.aggregate(
        F.filter(layers, lambda x: x["value"] != ""),
        F.get(F.filter(layers, lambda x: x["value"] != ""), F.lit(0)),
        lambda held, x: F.when(x["confidence"] > held["confidence"] + margin, x).otherwise(held),
    )


def verified(answer: Column, source: Column) -> Column:
    """Whether a model's answer stands in the source: as a whole, or all its words."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return (F.instr(F.lower(source), F.lower(answer)) > 0) | ((F.size(words(answer)) > 0) & (F.size(F.array_except(words(answer), words(source))) == 0))
