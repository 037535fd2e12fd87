"""DuckDB SQL for the queries of the catalogue, composed of common table expressions.

``RECORDS`` to ``RANKED`` state the linkage a second time, in another dialect, so a
difference between a query and its SQL is an error in one of them.
"""

from __future__ import annotations

from affinis.functions import constants as C
from affinis.functions.text import SPELLED
from affinis.sources.fixtures import RECORDS_SQL, TRUTH_SQL, extra_sql

STRINGS = "CAST([] AS VARCHAR[])"


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def _case(of: str, entries: dict[str, str], other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in entries.items()) + f" ELSE {other} END"


def norm(x: str) -> str:
    text = f"strip_accents(replace(replace(trim(lower(coalesce({x}, ''))), '&', ' and '), '/', ' '))"
    for a, b in SPELLED.items():
        text = f"replace({text}, '{a}', '{b}')"
    return f"trim(regexp_replace({text}, '[^a-z0-9]+', ' ', 'g'))"


def words(normal: str) -> str:
    return f"list_filter(string_split({normal}, ' '), lambda w: w <> '')"


def mapped(items: str, entries: dict[str, str]) -> str:
    return f"list_transform({items}, lambda w: {_case('w', entries, 'w')})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '(?:(?:^| )(?:{'|'.join(C.LEGAL_SUFFIXES)}))+$', '')"


MARKER = f"(?:^| )(?:{'|'.join(C.ALIAS_MARKERS)})(?: |$)"
POSTAL, NUMBER = r"^\d{5,6}$", r"^\d+[a-z]?$"


def fit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _distinct(x: str) -> str:
    """Distinct items in the order they come in."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def common(a: str, b: str) -> str:
    return f"CAST(len(list_distinct(list_intersect({a}, {b}))) AS DOUBLE)"


def overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) > 0)"


RECORDS = f"records AS ({RECORDS_SQL}), extra AS ({extra_sql()}), every_record AS (SELECT * FROM records UNION ALL SELECT * FROM extra)"

_STATES_US = {**{n: n for n in C.US_STATES.values()}, **C.US_STATES}
_STATES_IN = {**{n: n for n in C.INDIAN_STATES}, **C.INDIAN_CODES}


def _state(parts_item: str) -> str:
    """struct(state, at) of a component, or null."""
    plain = f"list_filter({parts_item}, lambda w: NOT {fit('w', POSTAL)})"

    def phrase(k: int) -> str:
        return f"array_to_string(({plain})[len({plain}) - {k - 1}:], ' ')"

    def state(k: int) -> str:
        return f"CASE country WHEN 'us' THEN {_case(phrase(k), _STATES_US, 'NULL')} WHEN 'india' THEN {_case(phrase(k), _STATES_IN, 'NULL')} END"

    return "CASE " + " ".join(f"WHEN len({plain}) >= {k} AND ({state(k)}) IS NOT NULL THEN {{'state': {state(k)}, 'before': len({plain}) - {k}}}" for k in (4, 3, 2, 1)) + " END"


def _no_numbers(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT {fit('w', NUMBER)})"


def _locality(x: str) -> str:
    return f"list_transform({_no_numbers(x)}, lambda w, i: CASE WHEN i = 1 AND w = 'street' THEN 'saint' ELSE w END)"


def profiles(source: str) -> str:
    """CTEs that end in ``profiles`` over the table ``source``."""
    country_text = "array_to_string(p, ' ')"
    not_country = f"len(p) > 0 AND NOT (%s <> '' AND {_case(country_text, C.COUNTRY_ALIASES, country_text)} = %s) AND {country_text} NOT IN {_in(C.COUNTRY_COMPONENTS)}"
    alias1, alias2 = (strip(f"trim(regexp_extract(mapped_name, '^(.*?){MARKER}(.*)$', {i}))") for i in (1, 2))
    has_postal = f"list_transform(parts, lambda p: len(list_filter(p, lambda w: {fit('w', POSTAL)})) > 0)"
    # (?<!\d)\d{5,6}(?!\d) within a component: a run of digits of that length
    postal_within = "list_transform(parts, lambda p: len(list_filter(regexp_extract_all(array_to_string(p, ' '), '[0-9]+'), lambda d: len(d) BETWEEN 5 AND 6)) > 0)"
    number_within = f"list_transform(parts, lambda p: len(list_filter(p, lambda w: {fit('w', NUMBER)})) > 0)"
    letters = fit("w", "[a-z]")
    markers = _in(C.LANDMARK_WORDS)
    return rf"""
  p1 AS MATERIALIZED (
    SELECT entity_id, business_name, coalesce(business_address, '') AS address_text, {norm('business_name')} AS name_raw, {norm('business_address')} AS address_raw, {norm('country')} AS c0 FROM {source}
  ), p2 AS MATERIALIZED (
    SELECT *, {_case('c0', C.COUNTRY_ALIASES, 'c0')} AS country, array_to_string({mapped(words('name_raw'), C.NAME_WORDS)}, ' ') AS mapped_name, {mapped(words('address_raw'), C.ADDRESS_WORDS)} AS address_words,
      list_transform(regexp_split_to_array(address_text, '[,;\n]+'), lambda t: {mapped(words(norm('t')), C.ADDRESS_WORDS)}) AS every_part,
      regexp_extract({norm("string_split(address_text, ',')[1]")}, '(?:^|[^a-z])(\d+[a-z]?)(?:[^a-z]|$)', 1) AS house_number
    FROM p1
  ), p3 AS MATERIALIZED (
    SELECT *, CASE WHEN {fit('mapped_name', MARKER)} THEN list_filter([{alias1}, {alias2}], lambda v: v <> '') ELSE {STRINGS} END AS aliased, list_filter([{strip('mapped_name')}], lambda v: v <> '') AS whole,
      list_filter(every_part, lambda p: {not_country % ('country', 'country')}) AS parts, list_filter(every_part, lambda p: {not_country % ("''", "''")}) AS all_parts
    FROM p2
  ), p4 AS MATERIALIZED (
    SELECT *, CASE WHEN len(aliased) > 0 THEN aliased ELSE whole END AS variants, list_transform(parts, lambda p: {_state('p')}) AS found_states, len(parts) AS n,
      len(parts) - coalesce(list_position(list_reverse({has_postal}), true), 0) AS postal_at,
      coalesce(list_position({postal_within}, true), 0) AS lp, coalesce(list_position({number_within}, true), 0) AS ln, coalesce(parts[1], {STRINGS}) AS first_part
    FROM p3
  ), p5 AS MATERIALIZED (
    SELECT *, coalesce(variants[1], '') AS name_core,
      CASE WHEN country IN ('us', 'india') THEN CASE WHEN n >= 1 AND found_states[n] IS NOT NULL THEN n WHEN n >= 2 AND found_states[n - 1] IS NOT NULL THEN n - 1 END END AS state_at,
      CASE WHEN postal_at < n AND len(list_filter(parts, lambda p: len(list_filter(p, lambda w: {fit('w', POSTAL)})) > 0)) > 0 THEN parts[postal_at + 1] END AS postal_part,
      CASE WHEN lp > 0 THEN parts[lp] END AS layout_part, coalesce(regexp_matches(first_part[1], '{NUMBER}'), false) AS starts
    FROM p4
  ), p6 AS MATERIALIZED (
    SELECT *, ({_no_numbers('parts[state_at]')})[1:least(found_states[state_at].before, len({_no_numbers('parts[state_at]')}))] AS front,
      {_no_numbers(f"postal_part[len(postal_part) - list_position(list_reverse(list_transform(postal_part, lambda w: {fit('w', POSTAL)})), true) + 2:]")} AS behind,
      coalesce(list_position(list_transform(layout_part, lambda w: {fit('w', POSTAL)}), true), 0) AS la
    FROM p5
  ), p7 AS MATERIALIZED (
    SELECT *, CASE WHEN n = 0 THEN {STRINGS}
        WHEN state_at IS NOT NULL THEN CASE WHEN len(front) > 0 THEN front WHEN state_at > 1 THEN parts[state_at - 1] ELSE {STRINGS} END
        WHEN postal_part IS NOT NULL THEN CASE WHEN len(behind) > 0 THEN behind WHEN postal_at > 0 THEN parts[postal_at] ELSE {STRINGS} END
        WHEN n >= 2 THEN parts[n] ELSE {STRINGS} END AS chosen,
      len(list_filter(layout_part[:CASE WHEN la > 0 THEN la ELSE len(layout_part) END - 1], lambda w: {letters})) > 0 AS text_before,
      len(list_filter(layout_part[la + 1:], lambda w: {letters})) > 0 AS text_after
    FROM p6
  ), profiles AS MATERIALIZED (
    SELECT entity_id, business_name, name_raw, variants, name_core, {words('name_core')} AS name_words, address_raw, address_words, country, {_locality('chosen')} AS city_words,
      CASE WHEN country IN ('us', 'india') THEN coalesce({_distinct("string_split(list_filter(list_reverse(found_states[greatest(n - 2, 1):n]), lambda s: s IS NOT NULL)[1].state, ' ')")}, {STRINGS}) ELSE {STRINGS} END AS state_words,
      {_distinct(f"list_filter(address_words, lambda w: {fit('w', NUMBER)})")} AS numbers,
      {_distinct(f"list_filter(list_transform(range(1, len(address_words) + 1), lambda i: CASE WHEN address_words[i] IN {_in(C.UNIT_WORDS)} THEN CASE WHEN address_words[i + 1] IN ('number', 'no') THEN address_words[i + 2] ELSE address_words[i + 1] END END), lambda u: u IS NOT NULL AND {fit('u', NUMBER)})")} AS units,
      {_distinct(r"list_filter(list_transform(regexp_extract_all(address_text, '\+?\d[\d\s()./-]{6,}\d'), lambda r: regexp_replace(r, '\D', '', 'g')), lambda d: len(d) BETWEEN 8 AND 15)")} AS phones,
      {_distinct("list_filter(regexp_extract_all(address_raw, '[0-9]+'), lambda d: len(d) BETWEEN 5 AND 6)")} AS postals,
      'c' || least(n, 4) || '|p' || CASE WHEN lp = 0 THEN 'none' WHEN lp = n THEN 'last' WHEN lp = 1 THEN 'first' ELSE 'middle' END
        || '|o' || CASE WHEN layout_part IS NULL THEN 'none' WHEN text_before AND NOT text_after THEN 'text_before' WHEN text_after AND NOT text_before THEN 'text_after' ELSE 'mixed' END
        || '|n' || CASE WHEN starts THEN '1' ELSE '0' END || '|h' || CASE WHEN ln = 0 THEN 'none' WHEN ln = 1 THEN 'first' WHEN ln = n THEN 'last' ELSE 'middle' END
        || '|f' || CASE WHEN starts THEN 'number_first' WHEN len(list_filter(first_part, lambda w: {fit('w', NUMBER)})) > 0 THEN 'number_later' WHEN len(first_part) > 0 THEN 'text' ELSE 'empty' END AS layout,
      house_number, regexp_extract(house_number, '^(\d+)([a-z]?)$', 1) AS house_base, regexp_extract(house_number, '^(\d+)([a-z]?)$', 2) AS house_suffix, all_parts
    FROM p7
  ), landmark_words AS MATERIALIZED (
    SELECT entity_id, list(DISTINCT w ORDER BY w) AS landmarks FROM (
      SELECT entity_id, tail, unnest(tail) AS w, unnest(range(1, len(tail) + 1)) AS spot FROM (
        SELECT entity_id, part[i + 1:i + 4] AS tail FROM (SELECT entity_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT entity_id, unnest(all_parts) AS part FROM profiles)) WHERE part[i] IN {markers}
      )
    ) WHERE spot < coalesce(list_position(list_transform(tail, lambda w: {fit('w', NUMBER)}), true), 99) AND w NOT IN {_in(C.STOP_WORDS)} GROUP BY entity_id
  )"""


def _soundex(x: str) -> str:
    """American Soundex of a lower-case word of letters."""
    digits = f"translate(substr({x}, 1, 1) || regexp_replace(substr({x}, 2), '[hw]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {x} = '' THEN '' ELSE upper(substr({x}, 1, 1)) || substr(replace(substr({digits}, 2), '0', '') || '000', 1, 3) END"


SOUNDEX = _soundex("regexp_replace(w, '[^a-z]', '', 'g')")


def worth(x: str, least: int) -> str:
    return f"list_filter({x}, lambda w: len(w) >= {least} AND w NOT IN {_in(C.STOP_WORDS)})"


def keys(ngrams: int = 6) -> str:
    """CTEs that end in ``keys`` (entity_id, channel, scope, value) over ``profiles``."""
    grams = "flatten(list_transform(variants, lambda v: list_transform(range(1, greatest(1, len(replace(v, ' ', '')) - 2) + 1), lambda i: substr(replace(v, ' ', ''), i, 3))))"
    even = f"CASE WHEN len(grams) <= {ngrams} THEN grams ELSE list_transform(range(0, {ngrams}), lambda i: grams[CAST(floor(i * (len(grams) - 1) / {max(1, ngrams - 1)}) AS INTEGER) + 1]) END"
    return f"""
  k1 AS MATERIALIZED (
    SELECT entity_id, country, variants, address_words, postals, house_number, city_words, list_transform(variants, lambda v: {worth("string_split(v, ' ')", 3)}) AS name_parts, {grams} AS grams FROM profiles
  ), k2 AS MATERIALIZED (
    SELECT entity_id, country, 'name_exact' AS channel, unnest(list_filter(variants, lambda v: len(v) >= 4)) AS value FROM k1
    UNION ALL SELECT entity_id, country, 'name_token', unnest(flatten(name_parts)) FROM k1
    UNION ALL SELECT entity_id, country, 'name_pair', unnest(flatten(list_transform(name_parts, lambda ws: list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) FROM k1
    UNION ALL SELECT entity_id, country, 'name_phonetic', unnest(list_filter(list_transform(flatten(name_parts), lambda w: {SOUNDEX}), lambda c: c <> '')) FROM k1
    UNION ALL SELECT entity_id, country, 'name_char_ngram', unnest({even}) FROM k1
    UNION ALL SELECT entity_id, country, 'address_token', unnest({worth('address_words', 4)}) FROM k1
    UNION ALL SELECT entity_id, country, 'postal', unnest(postals) FROM k1
    UNION ALL SELECT entity_id, country, 'house_number', house_number FROM k1 WHERE house_number <> ''
    UNION ALL SELECT entity_id, country, 'city_token', unnest({worth('city_words', 3)}) FROM k1
  ), keys AS MATERIALIZED (
    SELECT DISTINCT entity_id, channel, scope, value FROM (SELECT entity_id, channel, country AS scope, value FROM k2 UNION ALL SELECT entity_id, channel, '*', value FROM k2)
  )"""


def channels(max_frequency: int = 10_000, multiplier: float = 1.0) -> str:
    rows = ", ".join(f"('{c}', {w}, {max(1, int(-(-(top * multiplier) // 1)))}, {max_frequency * m})" for c, (w, top, m) in C.CHANNELS.items())
    return f"channels(channel, weight, top, ceiling) AS (VALUES {rows})"


TARGET, QUERY = "(entity_id LIKE 'S2-%' OR entity_id LIKE 'S3-%')", "entity_id LIKE 'S1-%'"

CONTEXT = f"""9.0 * CAST({overlap('q.postals', 't.postals')} AS INTEGER) + 4.0 * CAST(q.house_base <> '' AND q.house_base = t.house_base AS INTEGER) + 3.0 * ({jaccard('q.address_words', 't.address_words')})
      + 2.0 * ({jaccard('q.city_words', 't.city_words')}) + 1.0 * ({jaccard('q.name_words', 't.name_words')}) - 4.0 * CAST(q.country <> '' AND t.country <> '' AND q.country <> t.country AS INTEGER)"""


def retrieval(max_frequency: int = 10_000, mode: str = "once", most: int = 25) -> str:
    """CTEs that end in ``ranked`` over ``keys`` and ``profiles``."""
    score = "sum(score) + count(*) * any_value(context)" if mode == "per_channel" else "sum(score) + any_value(context) + 0.5 * ln(1 + (count(*) - 1))"
    hits = """SELECT q.entity_id AS query_id, q.channel, p.candidate_id, sum(round(c.weight * (ln((1.0 + d.documents) / (1.0 + p.df)) + 1.0), 12)) AS raw
      FROM keys q JOIN postings p USING (channel, scope, value) JOIN channels c ON c.channel = q.channel, documents d WHERE q.entity_id LIKE 'S1-%' AND q.channel {0} 'name_phonetic' {1} GROUP BY ALL"""
    return f"""
  {channels(max_frequency)}, documents AS (SELECT count(*) AS documents FROM profiles WHERE {TARGET}),
  frequencies AS MATERIALIZED (SELECT channel, scope, value, count(*) AS df FROM keys WHERE {TARGET} GROUP BY ALL),
  postings AS MATERIALIZED (SELECT k.channel, k.scope, k.value, k.entity_id AS candidate_id, f.df FROM keys k JOIN frequencies f USING (channel, scope, value) JOIN channels c ON c.channel = k.channel WHERE {TARGET} AND f.df <= c.ceiling),
  plain AS MATERIALIZED ({hits.format('<>', '')}),
  enough AS MATERIALIZED (SELECT query_id FROM plain GROUP BY query_id HAVING count(DISTINCT candidate_id) >= {C.FALLBACK_BELOW}),
  phonetic AS MATERIALIZED ({hits.format('=', 'AND q.entity_id NOT IN (SELECT query_id FROM enough)')}),
  scores AS MATERIALIZED (SELECT query_id, channel, candidate_id, round(raw, 9) AS score FROM plain UNION ALL SELECT query_id, channel, candidate_id, round(raw, 9) FROM phonetic),
  contexts AS MATERIALIZED (
    SELECT s.query_id, s.candidate_id, round({CONTEXT}, 9) AS context
    FROM (SELECT DISTINCT query_id, candidate_id FROM scores) s JOIN profiles q ON q.entity_id = s.query_id JOIN profiles t ON t.entity_id = s.candidate_id
  ), placed AS MATERIALIZED (
    SELECT s.*, x.context, row_number() OVER (PARTITION BY s.query_id, s.channel ORDER BY round(s.score + x.context, 9) DESC, s.candidate_id) AS place FROM scores s JOIN contexts x USING (query_id, candidate_id)
  ), selected AS MATERIALIZED (SELECT p.* FROM placed p JOIN channels c USING (channel) WHERE p.place <= c.top),
  merged AS MATERIALIZED (SELECT query_id, candidate_id, round({score}, 9) AS score, any_value(context) AS context, list(channel ORDER BY channel) AS channels FROM selected GROUP BY query_id, candidate_id),
  ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM merged) WHERE rank <= {most})"""


def base(extra: bool = False) -> str:
    return f"WITH {RECORDS}, {profiles('every_record' if extra else 'records')}"


def ranked(**how) -> str:
    return f"{base()}, {keys()}, {retrieval(**how)}"


TRUTH = f"truth AS ({TRUTH_SQL})"
