"""Field schemas and the expressions compiled from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.functions.values import normalize_value

KINDS = ("text", "name", "date", "time", "id_number", "reference", "sex", "number", "address")
NAME_ROLES = ("subject", "father", "mother", "spouse", "party")
DATE_ROLES = ("event_date", "birth_date", "death_date", "marriage_date", "registration_date", "issue_date")
EVENT_DATES = ("death_date", "marriage_date", "event_date", "birth_date")
KEY = "^[a-z][a-z0-9_]{0,62}$"
MOST_FIELDS = 200


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    kind: str = "text"
    role: str = "none"
    required: bool = False
    searchable: bool = False
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def by_role(self, *roles: str) -> list[Field]:
        return [f for r in roles for f in self.fields if f.role == r]

    def by_kind(self, kind: str) -> list[Field]:
        return [f for f in self.fields if f.kind == kind]

    @property
    def identifier(self) -> Field | None:
        return next(iter(self.by_role("identifier")), None)


#: Built-in schemas: what every certificate carries, and what each type adds.
COMMON = (
    Field("certificate_number", "Certificate number", "reference", "identifier", True, True),
    Field("registration_number", "Registration number", "reference", "secondary_identifier", False, True),
    Field("registration_date", "Registration date", "date", "registration_date"),
    Field("issue_date", "Issue date", "date", "issue_date"),
    Field("issuing_authority", "Issuing authority", "text", "issuing_authority"),
    Field("remarks", "Remarks"),
)
BY_TYPE = {
    "BIRTH": (Field("child_name", "Name of child", "name", "subject", True, True), Field("date_of_birth", "Date of birth", "date", "birth_date", True), Field("sex", "Sex", "sex"), Field("father_name", "Father's name", "name", "father", True, True), Field("mother_name", "Mother's name", "name", "mother"), Field("father_id", "Father's identity number", "id_number"), Field("mother_id", "Mother's identity number", "id_number"), Field("place_of_birth", "Place of birth", "address")),
    "DEATH": (Field("deceased_name", "Name of deceased", "name", "subject", True, True), Field("date_of_death", "Date of death", "date", "death_date", True), Field("date_of_birth", "Date of birth", "date", "birth_date"), Field("age", "Age", "number", "age"), Field("sex", "Sex", "sex"), Field("deceased_id", "Identity number", "id_number"), Field("informant_id", "Informant's identity number", "id_number")),
    "MARRIAGE": (Field("groom_name", "Name of groom", "name", "party", True, True), Field("bride_name", "Name of bride", "name", "party", True, True), Field("date_of_marriage", "Date of marriage", "date", "marriage_date", True), Field("groom_birth", "Groom's date of birth", "date", "birth_date"), Field("bride_birth", "Bride's date of birth", "date", "birth_date"), Field("dower", "Dower", "number")),
    "OTHER": (),
}


def builtin(certificate_type: str) -> Schema:
    return Schema(COMMON + BY_TYPE[certificate_type])


def draft_problems(fields: DataFrame) -> DataFrame:
    """(schema_id, problem) of draft schemas: bad or repeated keys, blank labels, searchable fields without a role, not one identifier, too many fields."""
    one = fields.select("schema_id", F.expr("inline(filter(array(struct(if(not name rlike '" + KEY + "', 'bad_key', null) as problem), struct(if(trim(label) = '', 'blank_label', null) as problem), struct(if(searchable and role = 'none', 'searchable_without_role', null) as problem)), x -> x.problem is not null))"))
    many = fields.groupBy("schema_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.count_if(F.col("role") == "identifier").alias("ids"))
    found = F.array(F.when(F.col("names") < F.col("n"), "repeated_key"), F.when(F.col("ids") != 1, "identifiers"), F.when(F.col("n") > MOST_FIELDS, "too_many"))
    return one.distinct().unionByName(many.select("schema_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")))


def value(fields: str, name: str) -> Column:
    """A field's text out of a map column; null where missing or blank."""
    text = F.trim(F.try_element_at(F.col(fields), F.lit(name)))
    return F.when(text != "", text)


def normalized(schema: Schema, fields: str = "fields") -> Column:
    """The map with each known field in its canonical form; other keys go."""
    pairs = [F.struct(F.lit(f.name).alias("key"), F.when(value(fields, f.name).isNotNull(), normalize_value(f.kind, value(fields, f.name))).alias("value")) for f in schema.fields]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def draft(schema: Schema, fields: str = "fields") -> dict[str, Column]:
    """The register columns of a row: identifiers, names, dates. Without an identifier a row can't be filed."""
    first = lambda *roles: F.coalesce(*[value(fields, f.name) for f in schema.by_role(*roles)], F.lit(None).cast("string"))
    people = [value(fields, f.name) for f in schema.by_role("subject", "party")]
    second = F.get(F.filter(F.array(*people), lambda x: x.isNotNull()), F.lit(1)) if people else F.lit(None).cast("string")
    day = F.coalesce(*[F.try_to_date(value(fields, f.name), "yyyy-MM-dd") for f in schema.by_role(*EVENT_DATES)], F.lit(None).cast("date"))
    return {"number": first("identifier"), "registration_number": first("secondary_identifier"), "primary_name": first("subject", "party"), "secondary_name": second, "event_date": day, "fileable": first("identifier").isNotNull()}


def exploded(rows: DataFrame, schema: Schema, roles: tuple[str, ...], id_column: str, fields: str = "fields") -> DataFrame:
    """(id, role, field_name, position, value): a row for each field of some roles; the position counts within the role."""
    entries, seen = [], {}
    for f in (f for f in schema.fields if f.role in roles):
        entries.append(F.struct(F.lit(f.role).alias("role"), F.lit(f.name).alias("field_name"), F.lit(seen.setdefault(f.role, 0)).alias("position"), value(fields, f.name).alias("value")))
        seen[f.role] += 1
    return rows.select(id_column, F.inline(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))


def patched(old: Column, change: Column) -> Column:
    """A map after a patch: null clears a key, an absent key stays."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(change), k), F.lit(False)))
    return F.map_concat(kept, F.map_filter(change, lambda k, v: v.isNotNull()))


def changed_keys(old: Column, new: Column) -> Column:
    keys = F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new)))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))
