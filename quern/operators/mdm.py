"""Master data: cleaning, match keys, accepted matches and golden records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_inn, normalize_name


def clean_person(df: DataFrame, names: Sequence[str], digits: Sequence[str] = ()) -> DataFrame:
    """Names in lower case with single spaces, digit columns as digits only; empty results are null."""
    return df.withColumns({c: F.nullif(normalize_name(F.col(c)), F.lit("")) for c in names} | {c: F.nullif(normalize_inn(F.col(c)), F.lit("")) for c in digits})


def clean_document(df: DataFrame, number: str, category: str, keep: Sequence[str]) -> DataFrame:
    """Documents of the wanted categories, numbers as upper-case letters and digits."""
    return df.filter(F.col(category).isin(*keep)).withColumn(number, F.upper(F.regexp_replace(F.col(number), r"[^\p{L}\p{N}]", "")))


def aggregate_documents(df: DataFrame, owner: str, number: str, order: str) -> DataFrame:
    """Each owner's distinct numbers in order, joined by ``~``."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(number))))
    return df.groupBy(owner).agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r[number])), "~").alias("numbers"))


#: Ordinals and names of the match keys, which stand before a key's value.
KEY_TYPES = {"name": ("01", "FIO+BD"), "document": ("02", "DUL"), "inn": ("03", "INN")}


def match_keys(df: DataFrame, id_column: str, system: str, first: str, middle: str, birth: str, documents: str, inn: str) -> DataFrame:
    """(source_id, system_name, rule_value): a key of birth date, first and middle name, one of each document, one of the tax number.

    ``documents`` holds numbers joined by ``~``.  A null or empty part gives no key.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    key = lambda kind, value: F.concat(F.lit("::".join([*KEY_TYPES[kind], ""])), value)
    numbers = F.filter(F.split(F.coalesce(text(documents), F.lit("")), "~"), lambda n: n != "")
    keys = F.concat(F.array(key("name", F.concat(text(birth), F.lit(":"), text(first), F.lit(":"), text(middle)))), F.transform(numbers, lambda n: key("document", n)), F.array(key("inn", text(inn))))
    return df.select(F.col(id_column).alias("source_id"), F.col(system).alias("system_name"), F.explode(F.array_compact(keys)).alias("rule_value"))


def accept_matches(pairs: DataFrame) -> DataFrame:
    """(id, canonical_id): the smallest id of an id's direct pairs and itself (one hop)."""
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    return both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("canonical_id"))


def latest_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The rows of each key with the latest ``order`` value, ties kept."""
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last()))).filter("__rank = 1").drop("__rank")


def classify_party(category: Column, service_group: Column) -> Column:
    """PHYSICAL, LEGAL or UNKNOWN from a client's category and service group."""
    return (
        F.when((category == "P") & (service_group.isNull() | (service_group == "5")), "PHYSICAL")
        .when((category == "C") | ((category == "P") & (service_group == "0")), "LEGAL")
        .otherwise("UNKNOWN")
    )


def map_messages(df: DataFrame, value: str, wrapper: str, renames: Mapping[str, Mapping[str, str]], codes: Mapping[str, Mapping[str, str]], category: str, group: str, others: Sequence[str] = ()) -> DataFrame:
    """Columns of JSON messages of clients, renamed by the client's type, with values replaced by their dictionaries.

    A message is an object, or holds one as the first of its list ``wrapper``.  renames: type -> field -> column; codes: field ->
    value -> value; every column that any type has is a column here, null where the type has not; ``others`` are fields that
    keep their names.  Messages that are no object are left out.
    """
    inner = F.coalesce(F.get_json_object(F.col(value), f"$['{wrapper}'][0]"), F.col(value))
    d = df.withColumn("__m", F.from_json(inner, "map<string,string>")).filter(F.size("__m") > 0)
    field = lambda name: F.col("__m")[name] if name not in codes else _coded(F.col("__m")[name], codes[name])
    d = d.withColumn("party_type", classify_party(F.col("__m").getItem(category), F.col("__m").getItem(group)))
    out: dict[str, Column] = {}
    for kind, names in renames.items():
        for source, column in names.items():
            out[column] = F.when(F.col("party_type") == kind, field(source)).otherwise(out.get(column, F.lit(None).cast("string")))
    out |= {o: field(o) for o in others}
    return d.withColumns(out).drop("__m", value)


def _coded(v: Column, values: Mapping[str, str]) -> Column:
    """The dictionary's value, or the value itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[v], v) if values else v


#: Names of the consent types by their codes.
CONSENT_TYPES = {
    "0": "MFCMARKETING", "1": "ESIACREDIT", "2": "PERSONALDATA", "3": "BKI", "4": "ONLINEINTERACTION", "5": "MARKETING", "6": "IDENTIFICATION",
    "7": "FINANCE", "8": "REGQUESTIONNAIRE", "9": "DIGITALRUBLE", "10": "LONGORDER", "11": "JUNIORMOBILEAPPUSAGE",
}
#: Flags that say by what a consent's owner was verified.
CONSENT_FLAGS = ("flg_by_inn", "flg_by_duls", "flg_by_phones", "flg_by_birth_date", "flg_by_keys")


def link_consents(consents: DataFrame, parties: DataFrame, masters: DataFrame, now: Column) -> DataFrame:
    """Consents that are not deleted with their owner's attributes and master ids, one row an agreement.

    consents (agreement_id, agreement_type_cd, owner_id, deleted_ts, flags ..) and parties (owner_id, party_id, ..) meet by owner,
    masters (party_id, crm_id, mdm_id) by party; without a master crm_id is UNDEFINED and mdm_id empty.  Where an agreement or an
    owner repeats, the smallest row stands for it.
    """
    live = consents.filter(F.col("deleted_ts").isNull() | (F.col("deleted_ts").cast("string") == ""))
    live = live.withColumn("agreement_type_cd", _coded(F.col("agreement_type_cd").cast("string"), CONSENT_TYPES))
    flags = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f), F.lit("N")) if f in consents.columns else F.lit("N")) for f in CONSENT_FLAGS]
    live = _one_per(live.withColumn("verified_by", F.concat_ws("|", *flags)).drop(*CONSENT_FLAGS), "agreement_id")
    out = live.join(_one_per(parties, "owner_id"), "owner_id", "left").join(_one_per(masters, "party_id"), "party_id", "left")
    return out.withColumns({"crm_id": F.coalesce(F.nullif("crm_id", F.lit("")), F.lit("UNDEFINED")), "mdm_id": F.coalesce("mdm_id", F.lit("")), "map_created": now, "map_lastupd": now, "map_deleted": F.lit("")})


def _one_per(df: DataFrame, key: str) -> DataFrame:
    rest = [F.col(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
