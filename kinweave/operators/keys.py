"""Blocking keys: one row for each key of a record, in the order that breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import alnum, long_tokens, soundex, split_words
from kinweave.sources.staging import Stash

SHORT, LONG = 3, 4
#: Most frequent tokens that are broadcast.
BROADCAST = 100_000


def _key(kind: str, value: Column, gate: Column | None = None) -> Column:
    """gate: the token whose corpus frequency decides whether the key counts."""
    return F.struct(F.lit(kind).alias("key_type"), value.alias("key"), (F.lit(None).cast("string") if gate is None else gate).alias("gate"))


def _some(when: Column, *keys: Column) -> Column:
    return F.when(when, F.array(*keys)).otherwise(F.array().cast("array<struct<key_type:string,key:string,gate:string>>"))


def first2(name: Column) -> Column:
    """The key of type name_first2, of which a record has at most one; null without it."""
    return F.get(F.transform(F.array(long_tokens(name, SHORT)), lambda nt: F.concat(F.get(nt, F.lit(0)), F.lit(" "), F.get(nt, F.lit(1)))), F.lit(0))


def key_array(name: Column, address: Column, numbers: Column) -> Column:
    """All keys of a record as structs (key_type, key, gate); repeated tokens give repeated keys."""
    compact = alnum(name)
    nt, at = long_tokens(name, SHORT), long_tokens(address, SHORT)
    nums = F.filter(F.split(numbers, r"\|"), lambda x: F.length(x) >= SHORT)
    first, city = F.get(nt, F.lit(0)), F.try_element_at(at, F.lit(-1))
    has_name, has_address = F.size(nt) > 0, F.size(at) > 0

    def by_token(t: Column) -> Column:
        code = soundex(t)
        return F.filter(F.array(_key("name_token", t, t), _key("name_soundex", code, t)), lambda k: k["key"] != "")

    def joined(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit("_"), b)

    cross = F.flatten(F.transform(nums, lambda n: F.transform(at, lambda t: _key("addr_num_street", joined(n, t)))))
    none = F.array().cast("array<struct<key_type:string,key:string,gate:string>>")
    return F.concat(
        _some(F.length(compact) >= LONG, _key("name_compact", compact)),
        _some(F.length(compact) >= SHORT, _key("name_prefix", F.substring(compact, 1, 5))),
        _some(has_name, _key("name_first_token", first)),
        _some(F.size(nt) >= 2, _key("name_sorted", F.array_join(F.array_sort(nt), " ")), _key("name_first2", F.concat(first, F.lit(" "), F.get(nt, F.lit(1))))),
        F.flatten(F.transform(F.filter(nt, lambda t: F.length(t) >= LONG), by_token)),
        F.transform(F.filter(at, lambda t: F.length(t) >= LONG), lambda t: _key("addr_token", t, t)),
        F.transform(nums, lambda n: _key("addr_num", n)),
        F.when(has_name, F.transform(nums, lambda n: _key("name_num", joined(first, n)))).otherwise(none),
        cross,
        _some(has_name & has_address, _key("name_city", joined(first, city))),
        F.when(has_address, F.transform(nums, lambda n: _key("num_city", joined(n, city)))).otherwise(none),
    )


def explode_keys(records: DataFrame) -> DataFrame:
    """entity_id, country_norm, ord, key_type, key, gate of every key of normalised records."""
    rows = records.select("entity_id", "country_norm", F.posexplode(key_array(F.col("name_norm"), F.col("address_norm"), F.col("address_numbers"))).alias("ord", "k"))
    return rows.select("entity_id", "country_norm", "ord", "k.key_type", "k.key", "k.gate")


def token_frequency(records: DataFrame) -> DataFrame:
    """country_norm, token, freq: each record counts its name's and its address's distinct tokens."""
    tokens = F.concat(F.array_distinct(split_words(F.col("name_norm"))), F.array_distinct(split_words(F.col("address_norm"))))
    return records.select("country_norm", F.explode(tokens).alias("token")).groupBy("country_norm", "token").agg(F.count(F.lit(1)).alias("freq"))


def frequent(frequency: DataFrame, cap: int) -> DataFrame:
    """The rows of more than cap records, staged: with these, capped_keys() moves no keys where they are few."""
    return Stash(frequency.sparkSession)(frequency.where(F.col("freq") > cap))


def capped_keys(records: DataFrame, frequency: DataFrame, cap: int) -> DataFrame:
    """The keys whose token is in at most cap records of the frequency table; an unseen token passes."""
    frequent = frequency.where(F.col("freq") > cap).select(F.col("country_norm").alias("_c"), F.col("token").alias("_t"))
    if hasattr(frequency, "stash_path") and frequent.count() <= BROADCAST:
        frequent = F.broadcast(frequent)
    keys = explode_keys(records)
    return keys.join(frequent, (keys.country_norm == F.col("_c")) & (keys.gate == F.col("_t")), "left_anti").drop("gate")
