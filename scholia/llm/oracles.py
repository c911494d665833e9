"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from scholia.llm import mixture
from scholia.llm.rules import STOPS, SYMBOLS, VERDICT
from scholia.llm.secret_scan import BASE, RULES

#: The words of a text, for DuckDB's regular expressions.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _verdict() -> tuple[str, str]:
    """The threshold table as SQL: the failed names, and whether there are none."""
    cases = []
    for r in VERDICT:
        if r.least is not None:
            cases.append(f"CASE WHEN {r.measure} < {r.least} THEN '{r.name}' END")
        if r.most is not None:
            cases.append(f"CASE WHEN {r.measure} > {r.most} THEN '{r.name}' END")
    names = f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"
    return f"coalesce(array_to_string({names}, ','), '')", f"len({names}) = 0"


def op7() -> str:
    names, passed = _verdict()
    stops = ", ".join(f"'{w}'" for w in STOPS)
    over = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, t, {_WORDS.format("t")} AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
), g AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS k FROM s WHERE len(w) >= 5
), f AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1
), d AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM f GROUP BY r
), m AS (
  SELECT s.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '\PL', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_letters,
    len(list_filter(w, lambda x: x IN ({stops}))) AS stops, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM s LEFT JOIN d ON s.r = d.r
), q AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {over("word_chars", "n_words")} AS mean_word_length, {over("n_symbols", "word_chars")} AS symbol_ratio,
    {over("letters", "word_chars")} AS letter_ratio, {over("upper_letters", "letters")} AS upper_ratio,
    {over("stops", "n_words")} AS stop_word_ratio, {over("n_dup_lines", "n_lines")} AS dup_line_ratio,
    {over("bullets", "n_lines")} AS bullet_line_ratio, {over("ellipses", "n_lines")} AS ellipsis_line_ratio FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {passed} AS kept, {names} AS failed_rules FROM q"""


_TOKENS = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op9() -> str:
    """A longest match is an island of places on one diagonal of a document and an item."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS ir, item_id::VARCHAR AS item, {_TOKENS.format("coalesce(text, '')")} AS w FROM benchmark
), p AS (
  SELECT ir, item, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS ipos, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k+9], ' '))) AS k FROM i WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM p
), g AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda x: array_to_string(w[x:x+n-1], ' '))) AS k FROM d, sizes WHERE len(w) >= n
), h AS (
  SELECT g.r, g.pos, g.n, p.ir, p.item, p.ipos FROM g JOIN p ON g.k = p.k AND g.n = p.n
), marked AS (
  SELECT r, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS x FROM (SELECT DISTINCT r, pos, n FROM h)) GROUP BY r
), named AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ks FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
), runs AS (
  SELECT r, item, min(pos) - 1 AS a, max(pos) + any_value(n) - min(pos) AS size FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY r, ir, pos - ipos ORDER BY pos) AS island FROM h
  ) GROUP BY r, ir, item, pos - ipos, island
), best AS (
  SELECT r, size, a, item FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY size DESC, a, item NULLS LAST) = 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(size, 0)::BIGINT AS longest_match, a::BIGINT AS longest_at, item AS longest_item
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""


def op4() -> str:
    """All stretches of 50 words, as text."""
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, doc_id, unnest(range(0, len(w) - 49)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i+49], ' '))) AS k FROM d WHERE len(w) >= 50
), f AS (
  SELECT r, i, least FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c, min(doc_id) OVER (PARTITION BY k) AS least FROM g) WHERE c > 1
), n AS (
  SELECT *, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS island FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM f)
), s AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b, min(least) AS least FROM n GROUP BY r, island
)
SELECT d.doc_id, len(any_value(w))::BIGINT AS n_words, sum(b - a)::BIGINT AS n_repeated, count(*)::BIGINT AS n_spans,
  string_agg(a || ':' || b, ',' ORDER BY a) AS spans, min(least) AS first_doc_id
FROM s JOIN d USING (r) GROUP BY r, d.doc_id"""


def op5() -> str:
    """Gaps and matches of each kind alternate: running sums of their lengths are the spans."""
    kinds = []
    for k, r in enumerate(RULES):
        pattern = r.java.replace("'", "''")
        kinds.append(
            f"SELECT r, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(h, lambda x: length(x))) AS held,"
            f" unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS h, regexp_split_to_array(t, '{pattern}') AS g FROM d)"
        )
    counts = ", ".join(f"coalesce(count(*) FILTER (k = {k}), 0) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {" UNION ALL ".join(kinds)}
), p AS (
  SELECT *, sum(gap + n) OVER (PARTITION BY r, k ORDER BY i) - n AS a, sum(gap + n) OVER (PARTITION BY r, k ORDER BY i) AS b FROM m
), s AS (
  SELECT r, k, a, kind || ':' || a || ':' || b AS span FROM p WHERE held >= least
), f AS (
  SELECT r, {counts}, string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""


def op2() -> str:
    """The level of the water by running sums in the order of cap / weight; prefixes by running sums in the order of the hash."""
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixture.WEIGHTS)

    def prefix(name: str, test: str, goal: str) -> str:
        """Rows of one size class with ``more``: whether the middle of the row lies in the prefix."""
        return f"""
{name} AS (
  SELECT r, k, size, sum(size) OVER (PARTITION BY k ORDER BY u, r) - size + size / 2.0 <= {goal} AS more FROM x JOIN {name}_goal USING (k) WHERE size > 0 AND {test}
)"""

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'z') AS k, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(chr(31), '{mixture.SEED}', coalesce('s' || doc_id, 'z'), coalesce('s' || text, 'z'))), 1, 15))::BIGINT AS u FROM documents
), per AS (
  SELECT k, sum(size)::BIGINT AS s, count(*) AS n FROM d GROUP BY k
), w AS (
  SELECT k, s, n, [{weights}][(row_number() OVER (ORDER BY k) - 1) % {len(mixture.WEIGHTS)} + 1] AS w, s * {float(mixture.EPOCHS)}::DOUBLE AS cap FROM per
), water AS (
  SELECT k, cap / w AS ratio, ({mixture.BUDGET}::DOUBLE * sum(s) OVER ()::DOUBLE - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM w
  WINDOW o AS (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING)
), goals AS (
  SELECT k, s, n, target, whole, target - whole * s AS g FROM (
    SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS whole FROM (
      SELECT k, s, n, least(cap, coalesce((SELECT arg_min(level, (ratio, k)) FROM water WHERE level < ratio) * w, cap)) AS target FROM w
    )
  )
), x AS (
  SELECT r, k, size, u, size * n * 2 > s AS large FROM d JOIN goals USING (k)
), big_goal AS (
  SELECT k, any_value(g) * sum(size)::DOUBLE / any_value(s) AS first FROM x JOIN goals USING (k) WHERE size > 0 AND large GROUP BY k
), {prefix("big", "large", "first")}, small_goal AS (
  SELECT k, greatest(0.0, g - coalesce(took, 0)) AS second FROM goals LEFT JOIN (SELECT k, sum(size) FILTER (more) AS took FROM big GROUP BY k) USING (k)
), {prefix("small", "NOT large", "second")}, more AS (
  SELECT r, more FROM big UNION ALL SELECT r, more FROM small
)
SELECT doc_id, size, s AS source_size, target, size * (whole + coalesce(more, false)::BIGINT) AS taken, whole + coalesce(more, false)::BIGINT AS copies
FROM d JOIN goals USING (k) LEFT JOIN more USING (r)"""


SQL = {
    "op2_mixture": op2(),
    "op4_suffix_dedup": op4(),
    "op5_secret_scan": op5(),
    "op7_quality_rules": op7(),
    "op9_benchmark_decontamination": op9(),
}
