"""The catalog's queries in DuckDB SQL, from shared common table expressions."""

from __future__ import annotations

from kinweave.functions.text import ABBREVIATIONS, LANDMARKS, LEGAL_FORMS, STOP_WORDS

S1, CAND = "source1_entity_id", "candidate_entity_id"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(var: str, values: dict[str, str]) -> str:
    return f"CASE {var} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {var} END"


def _fold(x: str) -> str:
    out = f"strip_accents({x})"
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("ø", "o")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({_fold(x)}), '&', ' and '), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def _set(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '|')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def _parts(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, '|'), lambda t: t <> ''))"


def _soundex(t: str) -> str:
    letters = f"regexp_replace(lower({t}), '[^a-z]', '', 'g')"
    runs = f"translate({letters}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000')"
    for c in "0123456":
        runs = f"regexp_replace({runs}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE left(rpad(left({letters}, 1) || replace(substr({runs}, 2), '0', ''), 4, '0'), 4) END"


RECORDS = rf"""
words AS (
  SELECT doc_id, lang, source, n_chars, {_words("coalesce(text, '')")} AS w FROM documents
), cut AS (
  SELECT *, unnest(range(0, greatest(1, CAST(ceil(len(w) / 16.0) AS BIGINT)))) AS run FROM words
), records AS (
  SELECT doc_id * 1000000 + run AS number, 'S' || (doc_id % 3 + 1) || '-' || (doc_id * 1000000 + run) AS entity_id,
    array_to_string(w[run * 16 + 1 : run * 16 + 6], ' ') AS business_name,
    concat_ws(' ', array_to_string(w[run * 16 + 7 : run * 16 + 16], ' '), coalesce(CAST(n_chars AS VARCHAR), ''), coalesce(source, '')) AS business_address,
    coalesce(lang, '') AS country, 'S' || (doc_id % 3 + 1) AS target_source
  FROM cut
)"""

TRUTH = f"""
heads AS (
  SELECT number, entity_id, country, target_source, left(concat_ws(' ', business_name, business_address), 40) AS head FROM records
), truth AS (
  SELECT 'S1-' || o.owner AS {S1}, h.entity_id AS {CAND}
  FROM heads h JOIN (SELECT country, head, min(number) AS owner FROM heads WHERE target_source = 'S1' GROUP BY ALL) o USING (country, head)
  WHERE h.target_source <> 'S1'
), roster AS (SELECT entity_id AS {S1} FROM records WHERE target_source = 'S1')"""

NORM = rf"""
tok AS (
  SELECT *, {_tokens("business_name")} AS tn, {_tokens("business_address")} AS ta FROM records
), norm0 AS (
  SELECT number, entity_id, business_name, business_address, country, target_source,
    array_to_string(list_filter(tn, lambda t: t NOT IN {_in(LEGAL_FORMS)} AND t NOT IN {_in(STOP_WORDS)}), ' ') AS name_norm,
    {_set(f"list_transform(list_filter(tn, lambda t: t IN {_in(LEGAL_FORMS)}), lambda t: {_case('t', LEGAL_FORMS)})")} AS legal_form,
    array_to_string(list_transform(list_filter(ta, lambda t: t NOT IN {_in(LANDMARKS)} AND t NOT IN {_in(STOP_WORDS)}), lambda t: {_case('t', ABBREVIATIONS)}), ' ') AS address_norm,
    array_to_string(regexp_extract_all(business_address, '\p{{Nd}}+'), '|') AS address_numbers,
    {_set(f"list_filter(ta, lambda t: t IN {_in(LANDMARKS)})")} AS landmark_tokens,
    trim(lower(strip_accents(country))) AS country_norm
  FROM tok
), norm AS (
  SELECT *, trim(name_norm || ' ' || address_norm || ' ' || country) AS combined_norm FROM norm0
)"""


def _struct(kind: str, key: str, gate: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"{{'t': '{kind}', 'k': {key}, 'g': {gate}}}"


def _some(when: str, *keys: str) -> str:
    return f"CASE WHEN {when} THEN [{', '.join(keys)}] ELSE [] END"


KEYED = rf"""
parts AS (
  SELECT entity_id, country_norm, target_source, regexp_replace(name_norm, '[^\p{{L}}\p{{N}}]', '', 'g') AS compact,
    list_filter({_words("name_norm")}, lambda t: length(t) >= 3) AS nt, list_filter({_words("address_norm")}, lambda t: length(t) >= 3) AS adt,
    list_filter(string_split(address_numbers, '|'), lambda t: length(t) >= 3) AS nums
  FROM norm
), listed AS (
  SELECT entity_id, country_norm, target_source, list_concat(
    {_some("length(compact) >= 4", _struct("name_compact", "compact"))},
    {_some("length(compact) >= 3", _struct("name_prefix", "left(compact, 5)"))},
    {_some("len(nt) > 0", _struct("name_first_token", "nt[1]"))},
    {_some("len(nt) >= 2", _struct("name_sorted", "array_to_string(list_sort(nt), ' ')"), _struct("name_first2", "nt[1] || ' ' || nt[2]"))},
    flatten(list_transform(list_filter(nt, lambda t: length(t) >= 4), lambda t: list_filter([{_struct("name_token", "t", "t")}, {_struct("name_soundex", _soundex("t"), "t")}], lambda k: k.k <> ''))),
    list_transform(list_filter(adt, lambda t: length(t) >= 4), lambda t: {_struct("addr_token", "t", "t")}),
    list_transform(nums, lambda n: {_struct("addr_num", "n")}),
    CASE WHEN len(nt) > 0 THEN list_transform(nums, lambda n: {_struct("name_num", "nt[1] || '_' || n")}) ELSE [] END,
    flatten(list_transform(nums, lambda n: list_transform(adt, lambda t: {_struct("addr_num_street", "n || '_' || t")}))),
    {_some("len(nt) > 0 AND len(adt) > 0", _struct("name_city", "nt[1] || '_' || adt[len(adt)]"))},
    CASE WHEN len(adt) > 0 THEN list_transform(nums, lambda n: {_struct("num_city", "n || '_' || adt[len(adt)]")}) ELSE [] END
  ) AS l FROM parts
), keyed AS (
  SELECT entity_id, country_norm, target_source, i AS ord, l[i].t AS key_type, l[i].k AS "key", l[i].g AS gate
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM listed)
)"""

FREQUENCY = f"""
frequency AS (
  SELECT country_norm, token, count(*) AS freq
  FROM (SELECT country_norm, unnest(list_concat(list_distinct({_words("name_norm")}), list_distinct({_words("address_norm")}))) AS token FROM norm WHERE target_source <> 'S1')
  GROUP BY ALL
), capped AS (
  SELECT k.entity_id, k.country_norm, k.target_source, k.ord, k.key_type, k."key"
  FROM keyed k LEFT JOIN frequency f ON f.country_norm = k.country_norm AND f.token = k.gate
  WHERE coalesce(f.freq, 0) <= 250
)"""

BUDGET = f"""
sizes AS (
  SELECT country_norm, key_type, "key", count(*) AS bucket_size, count(DISTINCT entity_id) AS bucket_records
  FROM capped WHERE target_source <> 'S1' GROUP BY ALL HAVING count(*) <= 5000
), asked AS (
  SELECT c.entity_id AS {S1}, c.country_norm, c.key_type, c."key", row_number() OVER w AS turn,
    coalesce(max(CASE WHEN s.bucket_records >= 150 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before
  FROM capped c JOIN sizes s USING (country_norm, key_type, "key") WHERE c.target_source = 'S1'
  WINDOW w AS (PARTITION BY c.entity_id ORDER BY s.bucket_size, c.ord)
), met AS (
  SELECT a.{S1}, r.entity_id AS {CAND}, min(a.turn) AS turn
  FROM asked a JOIN (SELECT DISTINCT country_norm, key_type, "key", entity_id FROM capped WHERE target_source <> 'S1') r USING (country_norm, key_type, "key")
  WHERE a.full_before = 0 GROUP BY ALL
), budgeted AS (
  SELECT {S1}, {CAND} FROM (
    SELECT *, count(*) OVER (PARTITION BY {S1} ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM met
  ) WHERE seen < 150
)"""

CLOSE = f"""
close_sizes AS (
  SELECT country_norm, "key" FROM keyed WHERE key_type = 'name_first2' AND target_source <> 'S1' GROUP BY ALL HAVING count(*) <= 5000
), close AS (
  SELECT DISTINCT l.entity_id AS {S1}, r.entity_id AS {CAND}
  FROM keyed l JOIN close_sizes USING (country_norm, "key") JOIN keyed r ON l.country_norm = r.country_norm AND l."key" = r."key"
  WHERE l.key_type = 'name_first2' AND r.key_type = 'name_first2' AND l.target_source = 'S1' AND r.target_source <> 'S1'
)"""


def _texts(pairs: str) -> str:
    columns = ["name_norm", "address_norm", "combined_norm", "address_numbers", "legal_form", "landmark_tokens", "country_norm"]
    picked = ", ".join(f"a.{c} AS s1_{c}, b.{c} AS cand_{c}" for c in columns)
    return f"""
pair_texts AS (
  SELECT p.{S1}, p.{CAND}, {picked} FROM {pairs} p JOIN norm a ON a.entity_id = p.{S1} JOIN norm b ON b.entity_id = p.{CAND}
)"""


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({_words(x)}), ' ')"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) > 0 THEN 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) ELSE 1.0 END"


SORTED_TEXTS = f"""
sorted_texts AS (
  SELECT {S1}, {CAND}, {_sorted("s1_name_norm")} AS n1, {_sorted("cand_name_norm")} AS n2, {_sorted("s1_address_norm")} AS a1, {_sorted("cand_address_norm")} AS a2 FROM pair_texts
), weighed AS (
  SELECT {S1}, {CAND}, CAST(0.7 AS DOUBLE) * ({_lev("n1", "n2")}) + CAST(0.3 AS DOUBLE) * ({_lev("a1", "a2")}) AS raw FROM sorted_texts
)"""

SCORED = (
    _texts("close")
    + ","
    + SORTED_TEXTS
    + f""",
scored AS (
  SELECT {S1}, {CAND}, probability, row_number() OVER (PARTITION BY {S1} ORDER BY probability DESC, {CAND}) AS prob_rank
  FROM (SELECT {S1}, {CAND}, round(raw, 6) AS probability FROM weighed)
)"""
)


def _exact() -> str:
    return f"""
exact AS (
  SELECT o.{S1}, t.entity_id AS {CAND}
  FROM norm t JOIN (
    SELECT country_norm, name_norm, address_norm, min(entity_id) AS {S1} FROM norm
    WHERE target_source = 'S1' AND name_norm <> '' AND address_norm <> '' GROUP BY ALL HAVING count(*) = 1
  ) o USING (country_norm, name_norm, address_norm)
  WHERE t.target_source <> 'S1'
)"""


def _numbered(at_most: int) -> str:
    return f"""
nums AS (
  SELECT entity_id, target_source, country_norm, name_norm, unnest(list_filter({_parts("address_numbers")}, lambda t: length(t) >= 3)) AS num FROM norm WHERE name_norm <> ''
), clear_nums AS (
  SELECT country_norm, name_norm, num FROM nums WHERE target_source = 'S1' GROUP BY ALL HAVING count(*) <= {at_most}
), numbered AS (
  SELECT l.entity_id AS {S1}, r.entity_id AS {CAND}, num
  FROM nums r JOIN nums l USING (country_norm, name_norm, num) JOIN clear_nums USING (country_norm, name_norm, num)
  WHERE r.target_source <> 'S1' AND l.target_source = 'S1'
)"""


def _token_set(x: str) -> str:
    return f"list_distinct({_words(x)})"


RULES = (
    _exact()
    + ","
    + _numbered(3)
    + f""",
overlapping AS (
  SELECT DISTINCT n.{S1}, n.{CAND} FROM numbered n
  JOIN (SELECT entity_id AS {S1}, {_token_set("address_norm")} AS l FROM norm) a USING ({S1})
  JOIN (SELECT entity_id AS {CAND}, {_token_set("address_norm")} AS r FROM norm) b USING ({CAND})
  WHERE len(list_intersect(l, r)) >= 2 AND CAST(len(list_intersect(l, r)) AS DOUBLE) / least(len(l), len(r)) >= 0.35
), rule_links AS (
  SELECT {S1}, {CAND} FROM (
    SELECT {S1}, {CAND}, row_number() OVER (PARTITION BY {S1} ORDER BY {CAND}) AS turn FROM (SELECT {S1}, {CAND} FROM exact UNION SELECT {S1}, {CAND} FROM overlapping)
  ) WHERE turn <= 8
)"""
)

CLEAN_NAME = f"list_filter({_token_set('name_norm')}, lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+'))"
FUZZY = (
    _exact()
    + ","
    + _numbered(4)
    + f""",
name_tokens AS (
  SELECT entity_id, target_source, country_norm, unnest({CLEAN_NAME}) AS token FROM norm WHERE name_norm <> ''
), rare_tokens AS (
  SELECT country_norm, token FROM name_tokens WHERE target_source = 'S1' GROUP BY ALL HAVING count(*) <= 2500
), evidence AS (
  SELECT {S1}, {CAND}, CAST(sum(w) AS BIGINT) AS weight FROM (
    SELECT {S1}, {CAND}, 6 AS w FROM exact
    UNION ALL SELECT {S1}, {CAND}, 4 FROM numbered
    UNION ALL SELECT l.entity_id, r.entity_id, 1 FROM name_tokens l JOIN name_tokens r USING (country_norm, token) JOIN rare_tokens USING (country_norm, token)
      WHERE l.target_source = 'S1' AND r.target_source <> 'S1'
  ) GROUP BY {S1}, {CAND}
)"""
)


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {union} > 0 THEN CAST({both} AS DOUBLE) / {union} ELSE 0.0 END"


def _counts(pairs: str) -> str:
    return f"""
flags AS (
  SELECT {S1}, {CAND}, max(p) AS p, max(t) AS t FROM (
    SELECT DISTINCT {S1}, {CAND}, 1 AS p, 0 AS t FROM {pairs} UNION ALL SELECT DISTINCT {S1}, {CAND}, 0, 1 FROM truth
  ) GROUP BY {S1}, {CAND}
), counts AS (
  SELECT r.{S1}, CAST(coalesce(sum(p), 0) AS BIGINT) AS n_pred, CAST(coalesce(sum(t), 0) AS BIGINT) AS n_true, CAST(coalesce(sum(p * t), 0) AS BIGINT) AS n_hit
  FROM roster r LEFT JOIN flags f USING ({S1}) GROUP BY r.{S1}
)"""


def _fbeta(pred: str = "n_pred", true: str = "n_true", hit: str = "n_hit") -> str:
    return f"CASE WHEN {true} = 0 THEN CASE WHEN {pred} = 0 THEN 1.0 ELSE 0.0 END WHEN {hit} = 0 THEN 0.0 ELSE CAST(1.25 AS DOUBLE) * {hit} / (CAST(0.25 AS DOUBLE) * {true} + {pred}) END"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _pair_of(column: str) -> tuple[str, str]:
    return f"s1_{column}", f"cand_{column}"


def _grams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, length({x}) - 2) + 1), lambda i: substr({x}, i, 3))) END"


def _native_sql() -> dict[str, str]:
    name, address = _pair_of("name_norm"), _pair_of("address_norm")
    sets = {k: tuple(map(_token_set, _pair_of(f"{k}_norm"))) for k in ("name", "address", "combined")}
    bars = {k: tuple(map(_parts, _pair_of(k))) for k in ("address_numbers", "legal_form", "landmark_tokens")}

    def flag(x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def common(x: tuple[str, str]) -> str:
        return f"len(list_intersect({x[0]}, {x[1]}))"

    def both(x: tuple[str, str]) -> str:
        return f"len({x[0]}) > 0 AND len({x[1]}) > 0"

    def coefficient(x: tuple[str, str]) -> str:
        return f"CASE WHEN least(len({x[0]}), len({x[1]})) > 0 THEN CAST({common(x)} AS DOUBLE) / least(len({x[0]}), len({x[1]})) ELSE 0.0 END"

    def ratio(x: tuple[str, str]) -> str:
        return f"CASE WHEN greatest(length({x[0]}), length({x[1]})) > 0 THEN CAST(least(length({x[0]}), length({x[1]})) AS DOUBLE) / greatest(length({x[0]}), length({x[1]})) ELSE 0.0 END"

    def prefix(x: tuple[str, str]) -> str:
        return flag(f"(length({x[0]}) >= 4 AND length({x[1]}) >= 4 AND left({x[0]}, 4) = left({x[1]}, 4))")

    exact = f"({name[0]} <> '' AND {name[0]} = {name[1]})"
    out = {f"{k}_jaccard": _jac(*sets[k]) for k in sets}
    out |= {f"{k}_char3gram_jaccard": _jac(*map(_grams, x)) for k, x in (("name", name), ("address", address))}
    out |= {"shared_name_tokens": flag(common(sets["name"])), "shared_address_tokens": flag(common(sets["address"])), "shared_numbers": flag(common(bars["address_numbers"]))}
    out |= {"has_number_overlap": flag(f"({common(bars['address_numbers'])} > 0)"), "number_conflict": flag(f"({both(bars['address_numbers'])} AND {common(bars['address_numbers'])} = 0)")}
    out |= {"legal_form_overlap": flag(f"({common(bars['legal_form'])} > 0)"), "legal_form_conflict": flag(f"({both(bars['legal_form'])} AND {common(bars['legal_form'])} = 0)"), "landmark_overlap": flag(f"({common(bars['landmark_tokens'])} > 0)")}
    out |= {f"{k}_overlap_coefficient": coefficient(sets[k]) for k in ("name", "address")}
    out |= {"name_levenshtein": _lev(*name), "address_levenshtein": _lev(*address)}
    out |= {"same_country": flag("(s1_country_norm = cand_country_norm)"), "candidate_is_s2": flag(f"starts_with({CAND}, 'S2-')"), "candidate_is_s3": flag(f"starts_with({CAND}, 'S3-')")}
    out |= {f"{k}_length_diff": flag(f"abs(length({x[0]}) - length({x[1]}))") for k, x in (("name", name), ("address", address))}
    out |= {f"{who}_{k}_token_count": flag(f"len({sets[k][i]})") for k in ("name", "address") for i, who in enumerate(("s1", "candidate"))}
    out |= {"name_exact_match": flag(exact), "address_exact_match": flag(f"({address[0]} <> '' AND {address[0]} = {address[1]})")}
    out |= {"name_length_ratio": ratio(name), "address_length_ratio": ratio(address), "address_presence": flag(f"({address[1]} <> '')"), "exact_name_missing_addr": flag(f"({exact} AND {address[1]} = '')")}
    return out | {"name_prefix4_match": prefix(name), "address_prefix4_match": prefix(address)}


def _features(names: list[str]) -> str:
    made = _native_sql()
    return _with(RECORDS, NORM, KEYED, CLOSE, _texts("close")) + f" SELECT {S1}, {CAND}, " + ", ".join(f"round(CAST({made[n]} AS DOUBLE), 6) AS {n}" for n in names) + " FROM pair_texts"


def _token_block(k: int) -> str:
    tokens = _token_set("concat_ws(' ', name_norm, address_norm, replace(address_numbers, '|', ' '))")
    return f"""
token_sets AS (SELECT entity_id, target_source, country_norm, {tokens} AS tokens FROM norm),
token_rows AS (SELECT entity_id, target_source, country_norm, unnest(tokens) AS token FROM token_sets),
token_rare AS (SELECT country_norm, token FROM token_rows WHERE target_source <> 'S1' GROUP BY ALL HAVING count(*) <= 20000),
token_shared AS (
  SELECT l.entity_id AS {S1}, r.entity_id AS {CAND}, count(*) AS shared
  FROM token_rows l JOIN token_rows r USING (country_norm, token) JOIN token_rare USING (country_norm, token)
  WHERE l.target_source = 'S1' AND r.target_source <> 'S1' GROUP BY ALL
), token_most AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S1} ORDER BY shared DESC, {CAND}) AS r FROM token_shared) WHERE r <= {20 * k}
), token_scored AS (
  SELECT m.{S1}, m.{CAND}, CAST(m.shared AS DOUBLE) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS score
  FROM token_most m JOIN token_sets a ON a.entity_id = m.{S1} JOIN token_sets b ON b.entity_id = m.{CAND}
), token_top AS (
  SELECT {S1}, {CAND}, round(score, 6) AS token_score, CAST(r AS INTEGER) AS token_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {S1} ORDER BY score DESC, {CAND}) AS r FROM token_scored) WHERE r <= {k}
)"""


def _tfidf(k: int) -> str:
    parts = []
    for n in (3, 4, 5):
        # a padded word shorter than 3 can't occur: words have a character and two spaces
        parts.append(f"CASE WHEN length(p) >= {n} THEN list_transform(range(1, length(p) - {n - 2}), lambda i: substr(p, i, {n})) ELSE [] END")
    return f"""
names AS (
  SELECT entity_id, target_source, country_norm, name_norm FROM norm
), padded AS (
  SELECT entity_id, target_source, country_norm, ' ' || unnest({_words("name_norm")}) || ' ' AS p FROM names
), grams AS (
  SELECT entity_id, target_source, country_norm, unnest(list_concat({", ".join(parts)})) AS gram FROM padded
), tf AS (
  SELECT entity_id, target_source, country_norm, gram, count(*) AS tf FROM grams GROUP BY ALL
), sides AS (SELECT country_norm, count(*) AS n FROM names WHERE target_source <> 'S1' GROUP BY ALL),
idf AS (
  SELECT country_norm, gram, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT country_norm, gram, count(*) AS df FROM tf WHERE target_source <> 'S1' GROUP BY ALL HAVING count(*) >= 2) JOIN sides USING (country_norm)
), raw AS (SELECT entity_id, target_source, country_norm, gram, tf * idf AS w FROM tf JOIN idf USING (country_norm, gram)),
unit AS (
  SELECT r.entity_id, target_source, country_norm, gram, w / norm AS weight FROM raw r JOIN (SELECT entity_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL) USING (entity_id)
), cosine AS (
  SELECT l.entity_id AS {S1}, r.entity_id AS {CAND}, round(sum(l.weight * r.weight), 9) AS score
  FROM unit l JOIN unit r USING (country_norm, gram) WHERE l.target_source = 'S1' AND r.target_source <> 'S1' GROUP BY ALL
), tfidf_top AS (
  SELECT {S1}, {CAND}, round(score, 6) AS name_tfidf_score, CAST(r AS INTEGER) AS name_tfidf_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {S1} ORDER BY score DESC, {CAND}) AS r FROM cosine) WHERE r <= {k}
)"""


def _ratios(source: str, columns: dict[str, tuple[str, str]]) -> str:
    """CTEs ending in `ratios`: source's pair ids with the Indel ratio (0 to 100) of each pair of text columns.

    The longest common subsequence comes from the bit-parallel recurrence on 128-bit integers, with the shorter text in
    the bits; where that exceeds 120 characters, from rows of the dynamic programme as lists.
    """
    parts, joins, picked = [], [], []
    for name, (a, b) in columns.items():
        parts.append(f"""
{name}_t AS (
  SELECT {S1}, {CAND}, CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS p, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS q FROM {source}
), {name}_u AS (SELECT DISTINCT p, q FROM {name}_t
), {name}_c AS (SELECT p, q, string_split(p, '') AS pc, string_split(q, '') AS qc FROM {name}_u WHERE length(p) BETWEEN 1 AND 120
), {name}_m AS (
  SELECT p, q, pc, qc, list_distinct(pc) AS dc, (CAST(1 AS HUGEINT) << CAST(len(pc) AS HUGEINT)) - 1 AS full_row FROM {name}_c
), {name}_b AS (
  SELECT *, list_transform(dc, lambda c: list_reduce(list_transform(range(len(pc)), lambda i: CASE WHEN pc[i + 1] = c THEN CAST(1 AS HUGEINT) << CAST(i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END), lambda u, v: u | v)) AS masks FROM {name}_m
), {name}_l AS (
  SELECT p, q, length(p) - bit_count(list_reduce(list_prepend(full_row, list_transform(qc, lambda c: coalesce(masks[list_position(dc, c)], CAST(0 AS HUGEINT)))), lambda r, m: ((r + (r & m)) | (r - (r & m))) & full_row)) AS lcs FROM {name}_b
  UNION ALL SELECT p, q, list_max(list_reduce(
      list_prepend(list_transform(range(length(p)), lambda i: 0), list_transform(string_split(q, ''), lambda c: list_transform(string_split(p, ''), lambda x: CAST(x = c AS INTEGER)))),
      lambda r, m: list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(r[i], CASE WHEN m[i] = 1 THEN coalesce(r[i - 1], 0) + 1 ELSE 0 END))))))
    FROM {name}_u WHERE length(p) > 120
  UNION ALL SELECT p, q, 0 FROM {name}_u WHERE length(p) = 0
), {name}_r AS (
  SELECT t.{S1}, t.{CAND}, l.lcs, length(p) + length(q) AS total FROM {name}_t t JOIN {name}_l l USING (p, q)
)""")
        joins.append(f"{name}_r")
        picked.append(f"CASE WHEN {name}_r.total = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(200 AS DOUBLE) * {name}_r.lcs / {name}_r.total END AS {name}")
    joined = joins[0] + "".join(f" JOIN {j} USING ({S1}, {CAND})" for j in joins[1:])
    return ",".join(parts) + f",\nratios AS (SELECT {S1}, {CAND}, {', '.join(picked)} FROM {joined})"


SET_TEXTS = ",".join(
    f"""
{k}_sets AS (
  SELECT {S1}, {CAND}, list_sort(list_intersect({_token_set(f"s1_{k}_norm")}, {_token_set(f"cand_{k}_norm")})) AS both_,
    list_sort(list_filter({_token_set(f"s1_{k}_norm")}, lambda t: NOT list_contains({_token_set(f"cand_{k}_norm")}, t))) AS own,
    list_sort(list_filter({_token_set(f"cand_{k}_norm")}, lambda t: NOT list_contains({_token_set(f"s1_{k}_norm")}, t))) AS other
  FROM pair_texts
)"""
    for k in ("name", "address")
) + f""",
set_texts AS (
  SELECT n.{S1}, n.{CAND}, """ + ", ".join(f"{t}.both_ AS {k}_both, {t}.own AS {k}_own, {t}.other AS {k}_other, array_to_string(list_concat({t}.both_, {t}.own), ' ') AS {k}_p, array_to_string(list_concat({t}.both_, {t}.other), ' ') AS {k}_q" for k, t in (("name", "n"), ("address", "a"))) + f"""
  FROM name_sets n JOIN address_sets a USING ({S1}, {CAND})
)"""


def _set_ratio(k: str) -> str:
    head = f"length(array_to_string({k}_both, ' '))"
    heads = ", ".join(f"CAST(200 AS DOUBLE) * {head} / ({head} + length({k}_{x}))" for x in "pq")
    return f"""CASE WHEN len({k}_both) + len({k}_own) = 0 OR len({k}_both) + len({k}_other) = 0 THEN 0.0
WHEN len({k}_both) > 0 AND (len({k}_own) = 0 OR len({k}_other) = 0) THEN 100.0
WHEN len({k}_both) > 0 THEN greatest({k}, {heads}) ELSE {k} END"""


def statements() -> dict[str, str]:
    from kinweave.plans.catalog import CAPS, JACCARDS, LEVENSHTEINS, OVERLAPS, PREFIXES, STRUCTURES, THRESHOLDS

    norm = _with(RECORDS, NORM)
    keyed = _with(RECORDS, NORM, KEYED)
    capped = _with(RECORDS, NORM, KEYED, FREQUENCY)
    close = _with(RECORDS, TRUTH, NORM, KEYED, CLOSE)
    scored = _with(RECORDS, TRUTH, NORM, KEYED, CLOSE, SCORED)
    ruled = _with(RECORDS, TRUTH, NORM, RULES)
    # every (threshold, cap): links and hits of each record, then the mean over the roster
    grid = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {c or 0} AS cap, {c or 2**31 - 1} AS most" for t in THRESHOLDS for c in CAPS)
    return {
        "record_scan": _with(RECORDS) + " SELECT * FROM records",
        "norm_name": norm + " SELECT entity_id, name_norm, legal_form, country_norm FROM norm",
        "norm_address": norm + " SELECT entity_id, address_norm, address_numbers, landmark_tokens, combined_norm FROM norm",
        "extract_numbers": norm + f" SELECT entity_id, unnest(list_filter({_parts('address_numbers')}, lambda t: length(t) >= 3)) AS num FROM norm",
        "soundex_keys": norm + f", t AS (SELECT DISTINCT unnest({_words('name_norm')}) AS token FROM norm) SELECT token, {_soundex('token')} AS code FROM t",
        "char3grams": norm + f", g AS (SELECT entity_id, {_grams('name_norm')} AS g FROM norm) SELECT entity_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(list_sort(g), '|') AS grams FROM g",
        "row_keys": keyed + " SELECT entity_id, CAST(len(l) AS BIGINT) AS n_keys, array_to_string(list_transform(l, lambda k: k.t || '=' || k.k), ';') AS keys FROM listed",
        "token_frequency": capped + " SELECT country_norm, token, freq FROM frequency",
        "bucket_sizes": keyed
        + """, b AS (SELECT country_norm, key_type, "key", count(*) AS bucket_size, count(DISTINCT entity_id) AS bucket_records FROM keyed WHERE target_source <> 'S1' GROUP BY ALL HAVING count(*) <= 5000)
SELECT country_norm, key_type, bucket_size, bucket_records, count(*) AS n_buckets FROM b GROUP BY ALL""",
        "capped_keys": capped + """ SELECT entity_id, count(*) AS n_keys, count(DISTINCT key_type || '=' || "key") AS n_distinct FROM capped WHERE target_source <> 'S1' GROUP BY entity_id""",
        "key_join_candidates": close + f" SELECT {S1}, count(*) AS n_candidates, min({CAND}) AS first_id, max({CAND}) AS last_id FROM close GROUP BY {S1}",
        "budgeted_candidates": _with(RECORDS, NORM, KEYED, FREQUENCY, BUDGET) + f" SELECT {S1}, count(*) AS n_candidates, CAST(sum(CAST(split_part({CAND}, '-', 2) AS HUGEINT)) AS VARCHAR) AS id_sum FROM budgeted GROUP BY {S1}",
        "topk_candidates": _with(RECORDS, NORM, KEYED, FREQUENCY, BUDGET)
        + f""", sets AS (SELECT entity_id, {_token_set("name_norm")} AS n, {_token_set("address_norm")} AS a FROM norm),
weighed AS (
  SELECT p.{S1}, p.{CAND}, round(CAST(0.7 AS DOUBLE) * ({_jac("x.n", "y.n")}) + CAST(0.3 AS DOUBLE) * ({_jac("x.a", "y.a")}), 9) AS score
  FROM budgeted p JOIN sets x ON x.entity_id = p.{S1} JOIN sets y ON y.entity_id = p.{CAND}
)
SELECT {S1}, {CAND}, round(score, 6) AS keyed_score, CAST(r AS INTEGER) AS keyed_rank
FROM (SELECT *, row_number() OVER (PARTITION BY {S1} ORDER BY score DESC, {CAND}) AS r FROM weighed) WHERE r <= 60""",
        "token_block_topk": _with(RECORDS, NORM, _token_block(5)) + " SELECT * FROM token_top",
        "tfidf_cosine_topk": _with(RECORDS, NORM, _tfidf(3)) + " SELECT * FROM tfidf_top",
        "truth_pairs": _with(RECORDS, TRUTH) + " SELECT * FROM truth",
        "truth_lists": _with(RECORDS, TRUTH) + f" SELECT r.{S1}, coalesce(string_agg(DISTINCT t.{CAND}, ',' ORDER BY t.{CAND}), '') AS matched_entity_ids, count(DISTINCT t.{CAND}) AS n_matches FROM roster r LEFT JOIN truth t USING ({S1}) GROUP BY r.{S1}",
        "label_pairs": close + f" SELECT c.{S1}, count(*) AS n_pairs, count(t.{CAND}) AS n_positive FROM close c LEFT JOIN truth t USING ({S1}, {CAND}) GROUP BY c.{S1}",
        "entity_fbeta": close + "," + _counts("close") + f" SELECT {S1}, n_pred, n_true, n_hit, round({_fbeta()}, 6) AS fbeta FROM counts",
        "macro_fbeta": ruled + "," + _counts("rule_links") + f" SELECT round(avg({_fbeta()}), 6) AS macro_fbeta FROM counts",
        "blocking_audit": close
        + ","
        + _counts("close")
        + f""" SELECT round(CAST(sum(n_hit) AS DOUBLE) / sum(n_true), 6) AS pair_recall,
round(avg(CASE WHEN n_true > 0 THEN CAST(n_hit = n_true AS DOUBLE) END), 6) AS full_entity_recall,
round(avg(n_pred), 6) AS avg_candidates_per_s1, round(avg({_fbeta(pred="n_hit")}), 6) AS oracle_macro_f05 FROM counts""",
        "miss_breakdown": close
        + ","
        + _counts("close")
        + """ SELECT count(*) AS with_truth, count(*) FILTER (n_pred = 0) AS no_candidates, count(*) FILTER (n_pred > 0 AND n_hit = 0) AS no_overlap,
count(*) FILTER (n_hit > 0 AND n_hit < n_true) AS partial, count(*) FILTER (n_hit = n_true) AS complete FROM counts WHERE n_true > 0""",
        "non_empty_rate": ruled + "," + _counts("rule_links") + " SELECT round(avg(CAST(n_pred > 0 AS DOUBLE)), 6) AS non_empty_rate, round(avg(n_pred), 6) AS mean_set_size FROM counts",
        "jaccard_features": _features(JACCARDS),
        "overlap_features": _features(OVERLAPS),
        "levenshtein_features": _features(LEVENSHTEINS),
        "structural_features": _features(STRUCTURES),
        "prefix_features": _features(PREFIXES),
        "jaro_winkler": _with(RECORDS, NORM, KEYED, CLOSE, _texts("close"))
        + f" SELECT {S1}, {CAND}, "
        + ", ".join(f"round(CASE WHEN s1_{k}_norm = cand_{k}_norm THEN 1.0 ELSE jaro_winkler_similarity(s1_{k}_norm, cand_{k}_norm) END, 6) AS {k}_jaro_winkler" for k in ("name", "address"))
        + " FROM pair_texts",
        "token_sort_ratio": _with(RECORDS, NORM, KEYED, CLOSE, _texts("close"), SORTED_TEXTS, _ratios("sorted_texts", {"name": ("n1", "n2"), "address": ("a1", "a2")}))
        + f" SELECT {S1}, {CAND}, round(name / 100, 6) AS name_token_sort_ratio, round(address / 100, 6) AS address_token_sort_ratio FROM ratios",
        "token_set_ratio": _with(RECORDS, NORM, KEYED, CLOSE, _texts("close"), SET_TEXTS, _ratios("set_texts", {"name": ("name_p", "name_q"), "address": ("address_p", "address_q")}))
        + f" SELECT {S1}, {CAND}, round({_set_ratio('name')} / 100, 6) AS name_token_set_ratio, round({_set_ratio('address')} / 100, 6) AS address_token_set_ratio FROM ratios JOIN set_texts USING ({S1}, {CAND})",
        "scored_candidates": _with(RECORDS, NORM, KEYED, FREQUENCY, BUDGET, _texts("budgeted"), SORTED_TEXTS, _ratios("sorted_texts", {"name": ("n1", "n2"), "address": ("a1", "a2")}))
        + f""", best AS (SELECT {S1}, {CAND}, round((CAST(0.7 AS DOUBLE) * name + CAST(0.3 AS DOUBLE) * address) / 100, 9) AS score FROM ratios)
SELECT {S1}, {CAND}, round(score, 6) AS keyed_score, CAST(r AS INTEGER) AS keyed_rank
FROM (SELECT *, row_number() OVER (PARTITION BY {S1} ORDER BY score DESC, {CAND}) AS r FROM best) WHERE r <= 60""",
        "strip_accents_full": _with(RECORDS) + " SELECT entity_id, lower(strip_accents(business_name)) AS folded FROM records",
        "predict_threshold_cap": scored + f" SELECT r.{S1}, coalesce(string_agg(s.{CAND}, ',' ORDER BY s.prob_rank), '') AS ids FROM roster r LEFT JOIN (SELECT * FROM scored WHERE probability >= 0.6 AND prob_rank <= 3) s USING ({S1}) GROUP BY r.{S1}",
        "predict_source_specific": scored + f" SELECT {S1}, {CAND}, probability, CAST(prob_rank AS INTEGER) AS prob_rank FROM scored WHERE prob_rank <= 4 AND probability >= CASE WHEN starts_with({CAND}, 'S2-') THEN 0.5 ELSE 0.8 END",
        "exclusive_assignment": scored + f" SELECT {S1}, {CAND}, probability FROM (SELECT *, row_number() OVER (PARTITION BY {CAND} ORDER BY probability DESC, {S1}) AS o FROM scored WHERE probability >= 0.4) WHERE o = 1",
        "tune_rule_grid": scored
        + f""", grid AS ({grid}), true_counts AS (SELECT r.{S1}, count(t.{CAND}) AS n_true FROM roster r LEFT JOIN truth t USING ({S1}) GROUP BY r.{S1}),
chosen AS (
  SELECT g.threshold, g.cap, s.{S1}, count(*) AS n_pred, count(t.{CAND}) AS n_hit
  FROM scored s JOIN grid g ON s.probability >= g.threshold AND s.prob_rank <= g.most LEFT JOIN truth t USING ({S1}, {CAND}) GROUP BY ALL
)
SELECT g.threshold, CAST(g.cap AS INTEGER) AS cap, round(avg({_fbeta("coalesce(c.n_pred, 0)", "n.n_true", "coalesce(c.n_hit, 0)")}), 6) AS macro_f05
FROM grid g CROSS JOIN true_counts n LEFT JOIN chosen c ON c.threshold = g.threshold AND c.cap = g.cap AND c.{S1} = n.{S1} GROUP BY g.threshold, g.cap""",
        "exact_links": _with(RECORDS, NORM, _exact()) + " SELECT * FROM exact",
        "rule_matcher": ruled + " SELECT * FROM rule_links",
        "evidence_weights": _with(RECORDS, NORM, FUZZY) + " SELECT weight, count(*) AS n_pairs FROM evidence GROUP BY weight",
        "fuzzy_matcher": _with(RECORDS, NORM, FUZZY)
        + f""", best AS (
  SELECT {S1}, {CAND}, weight FROM (SELECT *, row_number() OVER (PARTITION BY {CAND} ORDER BY weight DESC, {S1}) AS r FROM evidence) WHERE r <= 25
), bags AS (
  SELECT entity_id, {CLEAN_NAME} AS n, list_filter({_token_set("address_norm")}, lambda t: length(t) >= 3) AS a, list_filter({_parts("address_numbers")}, lambda t: length(t) >= 3) AS u FROM norm
), measured AS (
  SELECT b.{S1}, b.{CAND}, b.weight, {_jac("x.n", "y.n")} AS name_score, {_jac("x.a", "y.a")} AS address_score, len(list_intersect(x.u, y.u)) > 0 AS number_overlap
  FROM best b JOIN bags x ON x.entity_id = b.{S1} JOIN bags y ON y.entity_id = b.{CAND}
), judged AS (
  SELECT *, CAST(0.68 AS DOUBLE) * name_score + CAST(0.24 AS DOUBLE) * address_score + CASE WHEN number_overlap THEN CAST(0.08 AS DOUBLE) ELSE 0 END AS score FROM measured
)
SELECT {S1}, {CAND} FROM (
  SELECT {S1}, {CAND}, row_number() OVER (PARTITION BY {S1} ORDER BY {CAND}) AS turn FROM judged
  WHERE (score >= 0.82 AND name_score >= 0.70) OR (score >= 0.64 AND name_score >= 0.55 AND weight >= 2 AND (address_score >= 0.16 OR number_overlap))
) WHERE turn <= 8""",
        "target_pool_sample": _with(RECORDS, TRUTH) + f" SELECT entity_id, target_source FROM records WHERE target_source <> 'S1' AND (number % 7 = 0 OR entity_id IN (SELECT {CAND} FROM truth))",
        "stratified_split": _with(RECORDS, TRUTH)
        + f""", n AS (SELECT r.{S1}, count(t.{CAND}) AS n_matches FROM roster r LEFT JOIN truth t USING ({S1}) GROUP BY r.{S1}),
k AS (SELECT *, row_number() OVER (PARTITION BY n_matches > 0 ORDER BY md5('42:' || {S1}), {S1}) AS r, count(*) OVER (PARTITION BY n_matches > 0) AS c FROM n),
p AS (SELECT *, CASE WHEN c >= 3 THEN greatest(1, floor(c * CAST(0.2 AS DOUBLE))) ELSE floor(c * CAST(0.2 AS DOUBLE)) END AS p FROM k)
SELECT {S1}, n_matches, CASE WHEN r <= p THEN 'holdout' WHEN r <= 2 * p THEN 'tune' ELSE 'fit' END AS split FROM p""",
        "downsample_negatives": close
        + f""", lab AS (SELECT c.{S1}, c.{CAND}, CAST(t.{CAND} IS NOT NULL AS INTEGER) AS label FROM close c LEFT JOIN truth t USING ({S1}, {CAND})),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || {S1} || ':' || {CAND}), {S1}, {CAND}) AS r FROM lab)
SELECT {S1}, {CAND}, label FROM o WHERE label = 1 OR r <= greatest(1, (SELECT count(*) FROM lab WHERE label = 1)) * 2""",
        "dup_rows_check": norm + " SELECT concat_ws('|', country_norm, name_norm, address_norm) AS record_key, count(*) AS n_rows FROM norm GROUP BY 1 HAVING count(*) > 1",
        "subset_check": _with(RECORDS, TRUTH, NORM, RULES, KEYED, CLOSE) + f" SELECT * FROM close WHERE ({S1}, {CAND}) NOT IN (SELECT ({S1}, {CAND}) FROM rule_links)",
        "missing_ids": ruled + f" SELECT {S1} FROM roster WHERE {S1} NOT IN (SELECT {S1} FROM rule_links)",
        "list_audit": _with(RECORDS, TRUTH)
        + f""", lists AS (
  SELECT {S1}, string_agg({CAND}, ',' ORDER BY {CAND}) AS ids FROM truth GROUP BY {S1}
  UNION ALL SELECT min(entity_id), min(entity_id) || ',' || min(entity_id) || ',S1-1,X-1' FROM records WHERE target_source <> 'S1' GROUP BY country
), f AS (SELECT {S1}, list_filter(string_split(ids, ','), lambda x: x <> '') AS found FROM lists)
SELECT count(*) AS n_rows, count(*) FILTER (len(found) <> len(list_distinct(found))) AS rows_with_repeats,
  CAST(sum(len(list_filter(found, lambda x: starts_with(x, 'S1-')))) AS BIGINT) AS s1_ids,
  CAST(sum(len(list_filter(found, lambda x: NOT regexp_matches(x, '^S[123]-')))) AS BIGINT) AS other_ids,
  (SELECT count(*) FROM (SELECT {S1} FROM f GROUP BY {S1} HAVING count(*) > 1)) AS repeated_rows,
  (SELECT count(*) FROM roster WHERE {S1} NOT IN (SELECT {S1} FROM f)) AS missing_rows,
  (SELECT count(DISTINCT {S1}) FROM f WHERE {S1} NOT IN (SELECT {S1} FROM roster)) AS surplus_rows,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(found) AS x FROM f) WHERE x NOT IN (SELECT entity_id FROM records WHERE target_source <> 'S1')) AS unknown_ids
FROM f""",
        "multi_owner_targets": close + f" SELECT {CAND}, count(DISTINCT {S1}) AS n_owners FROM close GROUP BY {CAND} HAVING count(DISTINCT {S1}) > 1",
        "cross_country_links": _with(RECORDS)
        + f""", o AS (SELECT business_name AS n, min(entity_id) AS {S1} FROM records WHERE target_source = 'S1' AND business_name <> '' GROUP BY n)
SELECT o.{S1}, t.entity_id AS {CAND}, a.country AS s1_country, t.country AS cand_country
FROM o JOIN records t ON t.business_name = o.n AND t.target_source <> 'S1' JOIN records a ON a.entity_id = o.{S1} WHERE a.country IS DISTINCT FROM t.country""",
        "non_latin_audit": _with(RECORDS)
        + r""", h AS (SELECT country, regexp_matches(strip_accents(business_name), '[^\x00-\x7F]') AS n, regexp_matches(strip_accents(business_address), '[^\x00-\x7F]') AS a FROM records)
SELECT country, count(*) AS n_rows, count(*) FILTER (n) AS non_latin_name, count(*) FILTER (a) AS non_latin_address, count(*) FILTER (n OR a) AS non_latin_either FROM h GROUP BY country""",
        "country_stats": ruled
        + f""", n AS (SELECT r.country, count(l.{CAND}) AS n FROM records r LEFT JOIN rule_links l ON l.{S1} = r.entity_id WHERE r.target_source = 'S1' GROUP BY r.entity_id, r.country)
SELECT country, count(*) AS n_records, count(*) FILTER (n > 0) AS n_linked, round(avg(n), 6) AS mean_links FROM n GROUP BY country""",
        "country_spellings": norm + " SELECT country_norm, string_agg(DISTINCT country, '|' ORDER BY country) AS spellings FROM norm GROUP BY country_norm",
        "missed_pair_diagnosis": _with(RECORDS, TRUTH, NORM, RULES, KEYED, FREQUENCY)
        + f""", missed AS (SELECT DISTINCT {S1}, {CAND} FROM truth WHERE ({S1}, {CAND}) NOT IN (SELECT ({S1}, {CAND}) FROM rule_links)),
sets AS (SELECT entity_id, list(DISTINCT key_type || '=' || "key") AS k FROM capped GROUP BY entity_id),
shared AS (SELECT m.{S1}, m.{CAND}, coalesce(list_intersect(a.k, b.k), []) AS s FROM missed m LEFT JOIN sets a ON a.entity_id = m.{S1} LEFT JOIN sets b ON b.entity_id = m.{CAND})
SELECT {S1}, {CAND}, CAST(len(s) AS BIGINT) AS n_shared, array_to_string(list_sort(list_distinct(list_transform(s, lambda x: split_part(x, '=', 1)))), '|') AS key_types FROM shared""",
        "stratified_sample": _with(RECORDS, TRUTH)
        + f""", n AS (SELECT r.{S1}, count(t.{CAND}) AS n_matches FROM roster r LEFT JOIN truth t USING ({S1}) GROUP BY r.{S1}),
k AS (SELECT *, row_number() OVER (PARTITION BY n_matches > 0 ORDER BY md5('42:' || {S1}), {S1}) AS r FROM n),
s AS (SELECT count(*) FILTER (n_matches = 0) AS single FROM n),
t AS (SELECT least(single, CAST(round_even(1000 * least(CAST(0.20 AS DOUBLE), single / CAST(1000 AS DOUBLE)), 0) AS BIGINT)) AS take FROM s)
SELECT {S1}, n_matches FROM k, t WHERE CASE WHEN n_matches > 0 THEN r <= 1000 - take ELSE r <= take END""",
        "list_offenders": close
        + f""", lists AS (
  SELECT {S1}, string_agg({CAND}, ',' ORDER BY {CAND}) AS ids FROM close GROUP BY {S1}
  UNION ALL SELECT min(entity_id), min(entity_id) || ',' || min(entity_id) || ',S1-1,X-1,S2-x' FROM records WHERE target_source <> 'S1' GROUP BY country
), f AS (SELECT {S1} AS id, list_filter(string_split(ids, ','), lambda x: x <> '') AS found FROM lists),
i AS (SELECT DISTINCT unnest(found) AS id FROM f)
SELECT 'row_repeats' AS kind, id FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'id_repeats', id FROM f WHERE len(found) <> len(list_distinct(found))
UNION ALL SELECT 's1_id', id FROM i WHERE starts_with(id, 'S1-')
UNION ALL SELECT 'other_id', id FROM i WHERE NOT regexp_matches(id, '^S[123]-')
UNION ALL SELECT 'unknown_id', id FROM i WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records WHERE target_source <> 'S1')
UNION ALL SELECT DISTINCT 'missing_row', {S1} FROM roster WHERE {S1} NOT IN (SELECT id FROM f)
UNION ALL SELECT DISTINCT 'surplus_row', id FROM f WHERE id NOT IN (SELECT {S1} FROM roster)""",
        "country_targets": _with(RECORDS) + " SELECT entity_id, target_source, country FROM records WHERE target_source <> 'S1' AND country IN ('en', 'fr')",
        "indel_ratio": _with(RECORDS, NORM, KEYED, CLOSE, _texts("close"), _ratios("pair_texts", {"name": ("s1_name_norm", "cand_name_norm"), "address": ("s1_address_norm", "cand_address_norm")}))
        + f" SELECT {S1}, {CAND}, round(name, 6) AS name_ratio, round(address, 6) AS address_ratio FROM ratios",
        "country_id_lists": _with(RECORDS) + " SELECT DISTINCT entity_id FROM records WHERE country IN ('en', 'fr')",
        "clean_tokens": norm + f" SELECT entity_id, array_to_string(list_sort({CLEAN_NAME}), ' ') AS tokens FROM norm",
    }
