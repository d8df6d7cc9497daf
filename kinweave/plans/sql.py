"""DuckDB SQL for the registered queries: common table expressions that the queries share."""

from __future__ import annotations

from kinweave.functions import text as X

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def query(select: str) -> str:
    """``select`` with the tables it names, and those they name, in order."""
    import re

    need: list[str] = []

    def visit(body: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                visit(CTES[name])
                need.append(name)

    visit(select)
    own = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    for head in ("WITH RECURSIVE ", "WITH "):
        if need and select.startswith(head):
            return f"{head}{own},\n{select[len(head) :]}"
    return (f"WITH {own}\n" if need else "") + select


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, *rules: tuple[str, str]) -> str:
    """Replacements in order. RE2's boundaries know ASCII only, so the one other letter of the data is spelt out meanwhile."""
    expr = f"replace({expr}, 'ß', 'zqssqz')"
    for pattern, to in rules:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"
    return f"replace({expr}, 'zqssqz', 'ß')"


def spaces(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def words(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda x: x <> '')"


def one_of(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


cte(
    "ent",
    """SELECT doc_id AS ord, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:4], ' ') AS business_name,
  CASE WHEN doc_id % 31 = 1 THEN '' ELSE coalesce(CAST(n_chars AS VARCHAR), '') || ' ' || array_to_string(w[5:10], ' ') || ', ' || coalesce(source, '') END AS business_address,
  CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'India' ELSE coalesce(upper(lang), '') END AS country, text, lang
FROM (SELECT *, string_split(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') AS w FROM documents)""",
)
cte("s1", "SELECT * FROM ent WHERE entity_id LIKE 'S1-%'")
cte("targets", "SELECT * FROM ent WHERE entity_id NOT LIKE 'S1-%'")
cte("truth", "SELECT f.s1_id, t.entity_id AS t_id FROM targets t JOIN (SELECT text, lang, arg_min(entity_id, ord) AS s1_id FROM s1 GROUP BY text, lang) f ON t.text = f.text AND t.lang = f.lang")
_N, _A = "trim(lower(strip_accents(business_name)))", "trim(lower(strip_accents(business_address)))"
_NULLS = (r"(?i)\b(null|none)\b", " ")
cte(
    "rec",
    f"""SELECT *, {words("norm_name")} AS name_tokens, {words("norm_address")} AS address_tokens,
  regexp_extract_all(replace(business_address, 'ß', 'z'), '\\b\\d+\\b') AS address_numbers, trim(business_address) = '' AS is_address_empty
FROM (SELECT entity_id, country, business_name, business_address, ord, {spaces(rx(_N, *X.LEGAL_SUFFIXES, _NULLS))} AS norm_name, {spaces(rx(_A, *X.ADDRESS_SHORT, _NULLS))} AS norm_address FROM ent)""",
)
cte(
    "keys",
    """SELECT country, entity_id, unnest(k).t AS key_type, unnest(k).k AS key FROM (
  SELECT country, entity_id, list_filter([
    CASE WHEN length(name_tokens[1]) >= 3 THEN {'t': 'w1', 'k': name_tokens[1]} END,
    CASE WHEN length(name_tokens[1]) >= 3 THEN {'t': 'pfx3', 'k': name_tokens[1][1:3]} END,
    CASE WHEN length(name_tokens[1]) >= 4 THEN {'t': 'pfx', 'k': name_tokens[1][1:4]} END,
    CASE WHEN length(name_tokens[2]) >= 3 THEN {'t': 'w2', 'k': name_tokens[2]} END,
    CASE WHEN len(address_numbers) > 0 THEN {'t': 'num', 'k': address_numbers[1]} END,
    CASE WHEN len(s) > 0 THEN {'t': 'addr', 'k': s[1]} END], lambda x: x IS NOT NULL) AS k
  FROM (SELECT *, list_filter(address_tokens, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '\\d+')) AS s FROM rec))""",
)
cte(
    "cands",
    """SELECT s1_id, t_id, jaccard, row_number() OVER (PARTITION BY s1_id ORDER BY jaccard DESC, t_id) AS rank FROM (
  SELECT p.s1_id, p.t_id, CASE WHEN len(a.name_tokens) = 0 OR len(b.name_tokens) = 0 THEN 0.0
    ELSE len(list_intersect(a.name_tokens, b.name_tokens)) / len(list_distinct(list_concat(a.name_tokens, b.name_tokens))) END AS jaccard
  FROM (SELECT DISTINCT q.entity_id AS s1_id, k.entity_id AS t_id FROM keys q JOIN keys k USING (country, key_type, key)
        WHERE q.entity_id LIKE 'S1-%' AND k.entity_id NOT LIKE 'S1-%'
          AND (SELECT count(*) FROM keys z WHERE z.entity_id NOT LIKE 'S1-%' AND z.country = k.country AND z.key_type = k.key_type AND z.key = k.key) <= 2000) p
  JOIN rec a ON a.entity_id = p.s1_id JOIN rec b ON b.entity_id = p.t_id) QUALIFY rank <= 30""",
)
_J = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"
NJ, AJ = _J.format(a="a.name_tokens", b="b.name_tokens"), _J.format(a="a.address_tokens", b="b.address_tokens")
EMPTY = "(b.norm_address = '' OR b.is_address_empty)"
COMBINED = f"0.6 * ({NJ}) + 0.4 * CASE WHEN {EMPTY} THEN ({NJ}) ELSE ({AJ}) END"
PAIR = "FROM cands c JOIN rec a ON a.entity_id = c.s1_id JOIN rec b ON b.entity_id = c.t_id"
cte("scored", f"SELECT c.s1_id, c.t_id, {COMBINED} AS score {PAIR}")
cte(
    "pred",
    """SELECT s1_id, t_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY s1_id, t_id[1:2] ORDER BY score DESC, t_id) AS rank FROM (
    SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM scored) WHERE score >= 0.5 AND top - score <= 0.1) WHERE rank <= 3""",
)


def grams(col: str, pad: bool) -> str:
    s = f"(' ' || {col} || ' ')" if pad else col
    return f"CASE WHEN {col} = '' OR length({s}) < 3 THEN []::VARCHAR[] ELSE list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3)) END"


for _c, _t in (("name", "norm_name"), ("addr", "norm_address")):
    cte(f"g_{_c}", f"SELECT entity_id, g, count(*) AS n FROM (SELECT entity_id, unnest({grams(_t, True)}) AS g FROM rec) GROUP BY ALL")
    cte(f"l_{_c}", f"SELECT entity_id, sqrt(sum(n * n)) AS l FROM g_{_c} GROUP BY ALL")
    cte(
        f"cos_{_c}",
        f"""SELECT s1_id, t_id, dot / (x.l * y.l) AS cos FROM (SELECT c.s1_id, c.t_id, sum(p.n * q.n) AS dot FROM cands c
  JOIN g_{_c} p ON p.entity_id = c.s1_id JOIN g_{_c} q ON q.entity_id = c.t_id AND q.g = p.g GROUP BY ALL) JOIN l_{_c} x ON x.entity_id = s1_id JOIN l_{_c} y ON y.entity_id = t_id""",
    )


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS DOUBLE)"


NUM = flag("list_has_any(a.address_numbers, b.address_numbers)")
FEATURES14 = query(
    f"""SELECT c.s1_id, c.t_id, {flag("a.norm_name <> '' AND a.norm_name = b.norm_name")} AS name_exact, {NJ} AS name_jaccard,
  CASE WHEN len(a.name_tokens) > 0 THEN len(list_intersect(a.name_tokens, b.name_tokens)) / len(list_distinct(a.name_tokens)) ELSE 0.0 END AS name_recall,
  coalesce(n.cos, 0.0) AS name_char_cosine, {flag("length(a.norm_name) >= 4 AND a.norm_name[1:4] = b.norm_name[1:4]")} AS name_pfx_match,
  CAST(abs(length(a.norm_name) - length(b.norm_name)) AS DOUBLE) AS name_len_diff, CAST(abs(len(a.name_tokens) - len(b.name_tokens)) AS DOUBLE) AS name_token_diff,
  {flag(f"NOT {EMPTY} AND a.norm_address <> '' AND a.norm_address = b.norm_address")} AS addr_exact,
  CASE WHEN {EMPTY} THEN 0.0 ELSE {AJ} END AS addr_jaccard, CASE WHEN {EMPTY} THEN 0.0 ELSE coalesce(d.cos, 0.0) END AS addr_char_cosine,
  {NUM} AS addr_num_match, {flag(EMPTY)} AS is_addr_empty, {flag("a.country = b.country")} AS country_match, {COMBINED} AS combined_jaccard
{PAIR} LEFT JOIN cos_name n ON n.s1_id = c.s1_id AND n.t_id = c.t_id LEFT JOIN cos_addr d ON d.s1_id = c.s1_id AND d.t_id = c.t_id"""
)
_GN, _GA = (_J.format(a=f"list_distinct({grams('a.' + t, False)})", b=f"list_distinct({grams('b.' + t, False)})") for t in ("norm_name", "norm_address"))
FEATURES17 = query(
    f"""SELECT c.s1_id, c.t_id, {flag("a.norm_name <> '' AND a.norm_name = b.norm_name")} AS name_exact, {NJ} AS name_jaccard,
  CASE WHEN len(a.name_tokens) > 0 THEN len(list_intersect(a.name_tokens, b.name_tokens)) / len(list_distinct(a.name_tokens)) ELSE 0.0 END AS name_recall,
  {_GN} AS name_char_jaccard, {flag("a.name_tokens[1] = b.name_tokens[1]")} AS name_w1_match, {flag("a.name_tokens[2] = b.name_tokens[2]")} AS name_w2_match,
  {flag("length(a.norm_name) >= 4 AND length(b.norm_name) >= 4 AND a.norm_name[1:4] = b.norm_name[1:4]")} AS name_pfx4_match,
  {flag("length(a.norm_name) >= 6 AND length(b.norm_name) >= 6 AND a.norm_name[1:6] = b.norm_name[1:6]")} AS name_pfx6_match,
  {flag("a.norm_name <> '' AND b.norm_name <> '' AND (contains(a.norm_name, b.norm_name) OR contains(b.norm_name, a.norm_name))")} AS name_contain,
  CAST(abs(length(a.norm_name) - length(b.norm_name)) AS DOUBLE) AS name_len_diff, CAST(abs(len(a.name_tokens) - len(b.name_tokens)) AS DOUBLE) AS name_token_diff,
  {flag(f"NOT {EMPTY} AND a.norm_address = b.norm_address")} AS addr_exact, CASE WHEN {EMPTY} THEN 0.0 ELSE {AJ} END AS addr_jaccard,
  CASE WHEN {EMPTY} THEN 0.0 ELSE {_GA} END AS addr_char_jaccard, {NUM} AS addr_num_match, {flag(EMPTY)} AS is_addr_empty, {COMBINED} AS combined_jaccard
{PAIR}"""
)


def cleaner(expr: str, rules) -> str:
    s = f"replace(replace({expr}, '&', ' and '), '+', ' and ')"
    return spaces(rx(rx(s, *rules), (X.TLD, "")))


def by_country(expr: str) -> str:
    return f"CASE country WHEN 'France' THEN {cleaner(expr, X.FRANCE)} WHEN 'India' THEN {cleaner(expr, X.INDIA)} ELSE {cleaner(expr, X.US)} END"


_BRAND = f"trim(regexp_replace({rx('norm_name', (chr(92) + 'b(' + '|'.join(X.LEGAL_WORDS) + ')' + chr(92) + 'b', ' '))}, ' +', ' ', 'g'))"
_STATES = one_of(X.US_STATES)
_INDIA = "CASE " + " ".join(f"WHEN regexp_matches(replace(norm_addr, 'ß', 'z'), '\\b{n}\\b') THEN '{c}'" for n, c in X.INDIAN_STATES) + " ELSE '' END"
_SECTOR = "(?i)" + X.SECTOR
cte("rich0", f"SELECT entity_id, country, ord, business_name AS raw_name, business_address AS raw_addr, {by_country(_N)} AS norm_name, {by_country(_A)} AS norm_addr FROM ent")
cte("rich1", f"SELECT *, CASE WHEN {_BRAND} = '' THEN norm_name ELSE {_BRAND} END AS core_brand FROM rich0")
cte(
    "rich",
    f"""SELECT *,
  list_filter(list_transform(regexp_extract_all({rx("raw_addr", (_SECTOR, " "))}, '\\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '' AND length(x) <= 6) AS nums,
  regexp_extract_all(replace(raw_addr, 'ß', 'z'), '\\b\\d{{5,6}}\\b') AS pins,
  CASE WHEN norm_addr = '' THEN '' WHEN country = 'US' THEN coalesce(upper(list_filter(list_reverse({words("norm_addr")}), lambda t: t IN {_STATES})[1]), '')
       WHEN country = 'India' THEN {_INDIA} WHEN country = 'France' THEN regexp_extract(replace(raw_addr, 'ß', 'z'), '\\b(\\d{{5}})\\b', 1)[1:2] ELSE '' END AS geo,
  list_filter({words("norm_addr")}, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '\\d+') AND t NOT IN {one_of(X.STOP_ADDRESS_LONG)}) AS addr_tokens,
  list_filter({words("core_brand")}, lambda t: length(t) >= 2) AS stems,
  replace(core_brand, ' ', '') AS no_space, norm_addr IN {one_of(X.NULL_ADDRESSES)} AS is_addr_empty, regexp_matches(raw_name, '[^\\x00-\\x7F]') AS is_indic,
  core_brand IN {one_of(X.GENERIC_WORDS)} OR length(core_brand) <= 2 AS is_generic FROM rich1""",
)


def rich(profile: str) -> str:
    """The rich records of a profile, lists sorted and joined."""
    new = profile in ("v5", "train")
    rules = {"v2": (X.FRANCE, X.US_INDIA, X.US_INDIA), "production": (X.FRANCE, [*X.INDIA, *X.INDIA_STATE_NAMES], X.US), "v5": (X.FRANCE, X.INDIA, X.US)}.get(profile)

    def normal(expr: str) -> str:
        if rules is None:
            return spaces(rx(expr, (X.TLD, "")))
        return "CASE country " + " ".join(f"WHEN '{c}' THEN {cleaner(expr, r)}" for c, r in zip(("France", "India"), rules, strict=False)) + f" ELSE {cleaner(expr, rules[2])} END"

    b = chr(92) + "b"
    words_of = X.LEGAL_WORDS if new else X.TRADE_WORDS
    patterns = [(p, " ") for p in X.SUFFIX_PATTERNS] if profile == "v2" else [(f"{b}({'|'.join(words_of)}){b}", " ")]
    brand = f"trim(regexp_replace({rx('norm_name', *patterns)}, ' +', ' ', 'g'))"
    whole = "regexp_extract_all(replace(raw_addr, 'ß', 'z'), '\\b\\d+\\b')"
    runs = lambda src, n: f"list_filter(list_transform(regexp_extract_all({src}, '\\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '' AND length(x) <= {n})"
    nums = {
        "v2": f"list_transform({whole}, lambda x: regexp_replace(x, '^0+(.)', '\\1'))",
        "production": f"list_transform(list_filter(list_transform({whole}, lambda x: try_cast(x AS BIGINT)), lambda x: x < 100000000), lambda x: CAST(x AS VARCHAR))",
        "v5": runs("raw_addr", 8),
        "train": runs(rx("raw_addr", (_SECTOR, " ")), 6),
    }[profile]
    first = f"coalesce(list_filter({words('norm_addr')}, lambda t: t IN {_STATES})[1], '')"
    last = f"coalesce(upper(list_filter(list_reverse({words('norm_addr')}), lambda t: t IN {_STATES})[1]), '')"
    france = "WHEN country = 'France' THEN regexp_extract(replace(raw_addr, 'ß', 'z'), '\\b(\\d{5})\\b', 1)[1:2]" if profile == "v5" else ""
    geo = f"CASE WHEN norm_addr = '' THEN '' WHEN country = 'US' THEN {last} WHEN country = 'India' THEN {_INDIA} {france} ELSE '' END" if new else first
    long, stop = (4, X.STOP_ADDRESS_LONG) if new else (3, X.STOP_ADDRESS)
    tokens = f"list_filter({words('norm_addr')}, lambda t: length(t) >= {long} AND NOT regexp_full_match(t, '\\d+') AND t NOT IN {one_of(stop)})"
    joined = lambda x: f"array_to_string(list_sort(list_distinct({x})), ' ')"
    kept = brand if profile == "train" else f"CASE WHEN {brand} = '' THEN norm_name ELSE {brand} END"
    return f"""SELECT entity_id, norm_name, norm_addr, core_brand, {geo} AS geo, replace({"core_brand" if new else "norm_name"}, ' ', '') AS no_space,
  {joined(nums)} AS nums, {joined(tokens)} AS addr_tokens
FROM (SELECT *, {kept} AS core_brand FROM (SELECT entity_id, country, business_address AS raw_addr, {normal(_N)} AS norm_name, {normal(_A)} AS norm_addr FROM ent))"""


def in_order(expr: str) -> str:
    """Distinct elements in the order of their first place."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_NUMERALS = "regexp_extract_all(raw_addr, '\\d+')"
#: letters of the data beyond ASCII: for RE2, whose boundaries know ASCII only, each is spelt out as a run of ASCII letters
LETTERS = "àâäãáçéèêëíîïñóôöõúùûüß"


def spelt(expr: str, back: bool = False) -> str:
    for i, c in enumerate(LETTERS):
        code = "zqx" + chr(97 + i) + "xqz"
        expr = f"replace({expr}, '{code}', '{c}')" if back else f"replace({expr}, '{c}', '{code}')"
    return expr


def with_rules(expr: str, rules) -> str:
    expr = spelt(expr)
    for pattern, to in rules:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"
    return spelt(expr, back=True)


def _columnar(expr: str, address: bool) -> str:
    s = f"replace(lower({expr}), '&', ' and ')"
    s = f"trim(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'))"
    return f"CASE WHEN country = 'France' THEN {with_rules(s, X.FRANCE)} ELSE {with_rules(s, X.US_INDIA)} END" if address else s


def rich_rows(profile: str) -> str:
    """The rich records of a profile with their lists: entity_id, country, texts, geo, nums, raw_nums, addr_tokens, stems, flags."""
    if profile == "champion":
        return f"SELECT entity_id, trim(country) AS country, norm_name, norm_addr, core_brand, geo, no_space, nums, {in_order(_NUMERALS)} AS raw_nums, addr_tokens, {in_order('stems')} AS stems, is_addr_empty FROM rich"
    new = profile == "v5"
    if profile == "turbo":
        name, addr = _columnar("business_name", False), _columnar("business_address", True)
    else:
        rules = {"production": (X.FRANCE, [*X.INDIA, *X.INDIA_STATE_NAMES], X.US), "v5": (X.FRANCE, X.INDIA, X.US)}.get(profile, (X.FRANCE, X.US_INDIA, X.US_INDIA))
        normal = lambda e: "CASE country " + " ".join(f"WHEN '{c}' THEN {cleaner(e, r)}" for c, r in zip(("France", "India"), rules, strict=False)) + f" ELSE {cleaner(e, rules[2])} END"
        name, addr = normal(_N), normal(_A)
    b = chr(92) + "b"
    if profile in ("production", "turbo", "v5"):
        patterns = [(f"{b}({'|'.join(X.LEGAL_WORDS if new else X.TRADE_WORDS)}){b}", " ")]
    else:
        patterns = [(p, " ") for p in X.SUFFIX_PATTERNS]
    brand = f"trim(regexp_replace({with_rules('norm_name', patterns)}, ' +', ' ', 'g'))"
    last = f"coalesce(upper(list_filter(list_reverse({words('norm_addr')}), lambda t: t IN {_STATES})[1]), '')"
    first = f"coalesce(list_filter({words('norm_addr')}, lambda t: t IN {_STATES})[1], '')"
    geo = first
    if new:
        france = "WHEN country = 'France' THEN regexp_extract(replace(raw_addr, 'ß', 'z'), '\\b(\\d{5})\\b', 1)[1:2]"
        geo = f"CASE WHEN norm_addr = '' THEN '' WHEN country = 'US' THEN {last} WHEN country = 'India' THEN {_INDIA} {france} ELSE '' END"
    long, stop = (4, X.STOP_ADDRESS_LONG) if new else (3, X.STOP_ADDRESS)
    tokens = f"list_filter({words('norm_addr')}, lambda t: length(t) >= {long} AND NOT regexp_full_match(t, '\\d+') AND t NOT IN {one_of(stop)})"
    stems = f"list_filter({words('core_brand')}, lambda t: length(t) >= 2)"
    whole = f"regexp_extract_all({spelt('norm_addr' if profile == 'turbo' else 'raw_addr')}, '\\b\\d+\\b')"
    nums = {
        "production": f"list_transform(list_filter(list_transform({whole}, lambda x: try_cast(x AS BIGINT)), lambda x: x < 100000000), lambda x: CAST(x AS VARCHAR))",
        "v5": "list_filter(list_transform(regexp_extract_all(raw_addr, '\\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '' AND length(x) <= 8)",
    }.get(profile, f"list_transform({whole}, lambda x: regexp_replace(x, '^0+(.)', '\\1'))")
    empty = f"norm_addr IN {one_of(X.NULL_ADDRESSES)}" if new else "norm_addr = ''"
    return f"""SELECT entity_id, country, norm_name, norm_addr, core_brand, geo, no_space, nums, {in_order("raw_all")} AS raw_nums, addr_tokens, {in_order("all_stems")} AS stems, is_addr_empty
FROM (SELECT *, {geo} AS geo, replace({"core_brand" if new else "norm_name"}, ' ', '') AS no_space, {nums} AS nums, {_NUMERALS} AS raw_all, {tokens} AS addr_tokens, {stems} AS all_stems, {empty} AS is_addr_empty
FROM (SELECT *, CASE WHEN {brand} = '' THEN norm_name ELSE {brand} END AS core_brand
FROM (SELECT entity_id, trim(country) AS country, business_address AS raw_addr, {name} AS norm_name, {addr} AS norm_addr FROM ent)))"""


for _profile in ("v2", "production", "turbo", "v5", "champion"):
    cte(f"rows_{_profile}", rich_rows(_profile))


def gated(records: str, g) -> str:
    """The candidates of a gate over the rich records of a profile."""
    region = "CASE WHEN geo <> '' THEN list_transform(raw_nums, lambda n: {'kind': 'numgeo', 'key': n || '|' || geo}) ELSE [] END" if g.geo_numbers else "[]"
    limit = lambda most: f"CASE WHEN p.n <= {most} THEN true WHEN a.geo <> '' THEN p.geo = a.geo AND p.n_geo <= {g.geo} ELSE p.n_any <= {g.any} END"
    used = "" if g.no_space_query else "WHERE kind <> 'stem' OR place IS NOT NULL"
    chosen = "SELECT DISTINCT s1_id, t_id FROM stem_hits"
    if g.stop:
        chosen = f"""SELECT f.s1_id, f.t_id FROM first_hits f JOIN (SELECT s1_id, step, coalesce(sum(n) OVER (PARTITION BY s1_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT s1_id, step, count(*) AS n FROM first_hits GROUP BY s1_id, step)) u ON u.s1_id = f.s1_id AND u.step = f.step WHERE before < {g.stop}"""
    prefix = ""
    if g.prefix:
        prefix = f"""UNION SELECT a.id, p.id FROM asks a JOIN posts p USING (country, kind, key) WHERE kind = 'pfx' AND {limit(g.prefix_take)}
  AND a.id NOT IN (SELECT s1_id FROM chosen GROUP BY s1_id HAVING count(*) >= {g.prefix})"""
    return f"""WITH post0 AS (SELECT entity_id AS id, country, geo, stems, unnest(list_distinct(list_concat(list_concat(list_concat(
    list_transform(stems, lambda s: {{'kind': 'stem', 'key': s}}), list_transform(list_filter(stems[1:1], lambda s: length(s) >= 4), lambda s: {{'kind': 'pfx', 'key': s[1:4]}})),
    list_concat(CASE WHEN length(no_space) >= 5 THEN [{{'kind': 'stem', 'key': no_space}}] ELSE [] END,
      flatten(list_transform(raw_nums, lambda n: list_transform(addr_tokens[1:{g.address_words}], lambda w: {{'kind': 'num', 'key': n || '|' || w}}))))),
    list_concat(list_transform(list_filter(raw_nums, lambda n: length(n) >= 5), lambda n: {{'kind': 'pin', 'key': n}}), {region})))) AS k FROM rows_{records}),
  post AS (SELECT id, country, geo, stems, k.kind AS kind, k.key AS key FROM post0),
  posts AS (SELECT *, count(*) OVER (PARTITION BY country, kind, key) AS n, row_number() OVER (PARTITION BY country, kind, key ORDER BY id) AS n_any,
    row_number() OVER (PARTITION BY country, kind, key, geo ORDER BY id) AS n_geo FROM post WHERE id NOT LIKE 'S1-%'),
  asks AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'stem' THEN list_position(stems, key) END AS place FROM post WHERE id LIKE 'S1-%') {used}),
  stem_hits AS (SELECT a.id AS s1_id, p.id AS t_id, p.n, coalesce(a.place, 1 << 20) AS place FROM asks a JOIN posts p USING (country, kind, key) WHERE kind = 'stem' AND {limit(g.take)}),
  first_hits AS (SELECT s1_id, t_id, min(step) AS step FROM (SELECT *, dense_rank() OVER (PARTITION BY s1_id ORDER BY n, place) AS step FROM stem_hits) GROUP BY s1_id, t_id),
  chosen AS ({chosen})
SELECT s1_id, t_id FROM chosen {prefix}
UNION SELECT a.id, p.id FROM asks a JOIN posts p USING (country, kind, key) WHERE kind IN ('num', 'pin', 'numgeo') AND p.n <= {g.numbers}"""


_JOINED = "array_to_string(list_sort(list_distinct({0})), ' ') AS {0}"
RICH_TURBO = f"SELECT entity_id, norm_name, norm_addr, core_brand, geo, no_space, {_JOINED.format('nums')}, {_JOINED.format('addr_tokens')} FROM rows_turbo"


# ---- string similarities in SQL; arguments are names of columns ----


def indel(a: str, b: str) -> str:
    """200 LCS / (both lengths): the longest common subsequence by one bit vector of 128 for each letter, for texts under 126 characters."""
    full = f"((1::HUGEINT << length({a})::HUGEINT) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END))::HUGEINT)"
    state = f"list_reduce({masks}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    return f"(CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * (length({a}) - bit_count({state}))::DOUBLE / (length({a}) + length({b})) END)::DOUBLE"


def jaro(a: str, b: str) -> str:
    """DuckDB compares bytes: letters beyond ASCII become capitals, which these texts don't have."""
    ascii_ = lambda x: f"translate({x}, '{LETTERS}', '{''.join(chr(65 + i) for i in range(len(LETTERS)))}')"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({ascii_(a)}, {ascii_(b)}) END"


def ratios(source: str, name: tuple[str, str], address: tuple[str, str] | None = None) -> str:
    """``source`` with b_sort, b_set, b_lev, b_jaro of its columns ``name``, and a_sort, a_set, a_jaro of ``address``."""
    sides = {"b": name} | ({"a": address} if address else {})
    one, two, three = [], [], []
    for k, (x, y) in sides.items():
        one += [f"{words(c)} AS {k}_w{i}" for i, c in enumerate((x, y))]
        join = lambda e: f"array_to_string(list_sort(list_distinct({e})), ' ')"
        only = lambda i, j: f"list_filter({k}_w{i}, lambda x: NOT list_contains({k}_w{j}, x))"  # noqa: B023, E731
        two += [f"array_to_string(list_sort({k}_w{i}), ' ') AS {k}_s{i}" for i in (0, 1)]
        two += [f"{join(f'list_intersect({k}_w0, {k}_w1)')} AS {k}_c"]
        two += [f"trim({join(f'list_intersect({k}_w0, {k}_w1)')} || ' ' || {join(only(i, 1 - i))}) AS {k}_t{i}" for i in (0, 1)]
        common = f"greatest({indel(f'{k}_t0', f'{k}_t1')}, {indel(f'{k}_c', f'{k}_t0')}, {indel(f'{k}_c', f'{k}_t1')})"
        three += [
            f"{indel(f'{k}_s0', f'{k}_s1')} AS {k}_sort",
            f"CASE WHEN {k}_w0 = [] OR {k}_w1 = [] THEN 0.0 WHEN {k}_c <> '' THEN {common} ELSE {indel(f'{k}_t0', f'{k}_t1')} END AS {k}_set",
            f"{indel(x, y)} AS {k}_lev",
            f"{jaro(x, y)} AS {k}_jaro",
        ]
    return f"SELECT *, {', '.join(three)} FROM (SELECT *, {', '.join(two)} FROM (SELECT *, {', '.join(one)} FROM ({source})))"


def pair_rows(records: str, gate) -> str:
    """The candidates of a gate with what rules and vectors compare; x is source 1, y the target."""
    cols = "core_brand norm_addr geo no_space nums addr_tokens stems".split()
    both = ", ".join(f"{side}.{c} AS {side}_{c}" for side in "xy" for c in cols)
    script = lambda e: f"regexp_matches({e}.business_name, '[^\\x00-\\x7F]')"
    pins = lambda e: f"regexp_extract_all(replace({e}.business_address, 'ß', 'z'), '\\b\\d{{5,6}}\\b')"
    rows = f"""SELECT p.s1_id, p.t_id, {both}, y.is_addr_empty AS e, CASE WHEN y.is_addr_empty THEN '' ELSE y.norm_addr END AS y_addr, x.country = y.country AS same_country,
  x.geo <> '' AND y.geo <> '' AND x.geo <> y.geo AS region, x.geo <> '' AND x.geo = y.geo AS same_geo, {script("f")} AND NOT {script("d")} AS script,
  len(x.nums) > 0 AND len(y.nums) > 0 AS has, list_has_any(x.nums, y.nums) AS ov, x.no_space <> '' AND y.no_space <> '' AND (contains(x.no_space, y.no_space) OR contains(y.no_space, x.no_space)) AS inside,
  x.core_brand IN {one_of(X.GENERIC_WORDS)} OR length(x.core_brand) <= 2 OR y.core_brand IN {one_of(X.GENERIC_WORDS)} OR length(y.core_brand) <= 2 AS generic,
  {words("x.core_brand")}[1:2] AS x_two, {words("y.core_brand")}[1:2] AS y_two, list_has_any({pins("d")}, {pins("f")}) AS pins_meet
FROM ({gated(records, gate)}) p JOIN rows_{records} x ON x.entity_id = p.s1_id JOIN rows_{records} y ON y.entity_id = p.t_id JOIN ent d ON d.entity_id = p.s1_id JOIN ent f ON f.entity_id = p.t_id"""
    return ratios(rows, ("x_core_brand", "y_core_brand"), ("x_norm_addr", "y_addr"))
