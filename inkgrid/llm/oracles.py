"""DuckDB SQL for the queries that SQL can express, on the same definitions and parameters."""

from __future__ import annotations

from inkgrid.llm import decontaminate, lines, quality

WORD = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{WORD}'), lambda x: x <> '')"


def _quality() -> str:
    grid = ", ".join(f"('{name}', {list(cuts)})" for name, cuts in quality.GRID.items())
    features = " UNION ALL ".join(f"SELECT doc_id, stratum, '{name}' AS feature, {name} AS value FROM m" for name in quality.GRID)
    rate, cells = quality.ALPHA / len(quality.GRID), sum(map(len, quality.GRID.values()))
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_words("text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS filled FROM documents),
  win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t, unnest(range(1, len(w) - 1)) u(i)),
  dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
  cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(3) r(k) GROUP BY doc_id),
  b AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{WORD}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, len(filled) AS n_filled FROM t LEFT JOIN cover USING (doc_id)),
  m AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_permille, 1000 * n_dup_lines // greatest(n_filled, 1) AS dup_line_permille,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_word_permille, 100 * word_chars // greatest(n_words, 1) AS mean_word_centichars,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
  f AS ({features}), grid(feature, cuts) AS (VALUES {grid}),
  g AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
  held AS (SELECT f.stratum, f.feature, f.value, g.good FROM f JOIN g USING (doc_id) JOIN m USING (doc_id) WHERE NOT m.base_failed),
  tests AS (SELECT h.stratum, h.feature, cut, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND value >= cut) AS k_good,
    count(*) FILTER (NOT good AND value >= cut) AS k_bad FROM held h JOIN (SELECT feature, unnest(cuts) AS cut FROM grid) c ON c.feature = h.feature GROUP BY ALL),
  valid AS (SELECT *, round(k_bad / greatest(n_bad, 1) - {quality.COST} * k_good / greatest(n_good, 1), 9) AS gain FROM tests WHERE k_bad > 0 AND k_good < n_good * {rate}
    AND list_sum(list_transform(range(0, k_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({rate}) + (n_good - j) * ln(1 - {rate}))))
      <= {quality.DELTA} / ({cells} * (SELECT count(DISTINCT stratum) FROM held))),
  best AS (SELECT stratum, feature, cut FROM valid WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, feature ORDER BY gain DESC, cut DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM best JOIN f ON f.feature = best.feature AND f.stratum = best.stratum WHERE f.doc_id = m.doc_id AND f.value >= cut) AS kept FROM m"""


def _lines() -> str:
    leaf = ", ".join(["n", *(f"coalesce(t[{i + 1}], '')" for i in range(lines.DEPTH))])
    return f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  raw AS (SELECT doc_id, i - 1 AS line_no, {_words("l[i]")} AS t FROM s, unnest(range(1, len(l) + 1)) u(i)),
  m AS (SELECT doc_id, line_no, len(t) AS n, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END) AS t FROM raw WHERE len(t) > 0),
  keyed AS (SELECT *, ({leaf}) AS leaf FROM m),
  shared AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
  each AS (SELECT doc_id, line_no, n, leaf, i AS place, t[i] AS token FROM keyed JOIN shared USING (leaf), unnest(range(1, n + 1)) u(i)),
  usual AS (SELECT leaf, place, token FROM each WHERE token <> '' GROUP BY ALL HAVING count(*) >= {lines.MIN_DOCS}),
  judged AS (SELECT e.doc_id, e.line_no, e.n, e.leaf, e.place, CASE WHEN u.token IS NULL THEN chr(1) ELSE e.token END AS token, u.token IS NOT NULL AS firm FROM each e LEFT JOIN usual u ON u.leaf = e.leaf AND u.place = e.place AND u.token = e.token),
  placed AS (SELECT doc_id, line_no, leaf, string_agg(token, ' ' ORDER BY place) AS template FROM judged GROUP BY doc_id, line_no, n, leaf HAVING count(*) FILTER (firm) >= {lines.MIN_CONSTANT} * n),
  recurring AS (SELECT leaf, template, min((doc_id, line_no)) AS first FROM placed GROUP BY ALL HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
  gone AS (SELECT doc_id, list_sort(list(line_no)) AS dropped FROM placed JOIN recurring USING (leaf, template) WHERE (doc_id, line_no) <> first GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped,
  sha256(array_to_string(list_filter(l, lambda x, i: NOT coalesce(list_contains(dropped, i - 1), false)), chr(10))) AS text_sha256 FROM s LEFT JOIN gone USING (doc_id)"""


def _decontaminate() -> str:
    cut = r"[\x20\x09-\x0D.,;:!?\"''()\[\]{}]+".replace('\\"', '"')
    tokens = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{cut}'), lambda x: x <> '')"
    def seeds(t: str, id_: str, items: bool) -> str:
        each = lambda k, mask, low, high: f"SELECT {id_}, i AS place, {k} AS k, [{', '.join(f't[i + {p}]' for p in mask)}] AS seed FROM {t}, unnest(range(1, len(t) + 1 - {mask[-1]})) u(i)" + (f" WHERE len(t) BETWEEN {low} AND {high}" if items else f" WHERE EXISTS (SELECT 1 FROM b WHERE len(b.t) BETWEEN {low} AND {high})")
        return " UNION ALL ".join(each(k, *m) for k, m in enumerate(decontaminate.seed_masks()))

    return f"""WITH d AS (SELECT DISTINCT doc_id, text, {tokens} AS t FROM documents), b AS (SELECT DISTINCT item_id, text, {tokens} AS t FROM benchmark),
  ds AS ({seeds("d", "doc_id", False)}), bs AS ({seeds("b", "item_id", True)}),
  lines AS (SELECT DISTINCT doc_id, item_id, ds.place - bs.place AS o FROM ds JOIN bs ON ds.k = bs.k AND ds.seed = bs.seed),
  eq AS (SELECT l.doc_id, l.item_id, l.o, least(len(b.t), {decontaminate.WINDOW}) AS width, list_transform(b.t, lambda x, i: CASE WHEN i + o >= 1 AND x = d.t[i + o] THEN 1 ELSE 0 END) AS same FROM lines l JOIN d USING (doc_id) JOIN b USING (item_id)),
  best AS (SELECT doc_id, item_id, width, list_max(list_transform(range(1, len(same) - width + 2), lambda i: list_sum(list_slice(same, i, i + width - 1)))) AS matched FROM eq)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(width AS BIGINT) AS "window" FROM best WHERE matched >= ceil(width * {decontaminate.SHARE}) GROUP BY doc_id, item_id, width"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1),
  r AS (SELECT page_id, p.h, CASE WHEN page_id <> last THEN last END AS refers_to FROM p LEFT JOIN g ON g.h = p.h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

SQL: dict[str, str] = {"op1_decontamination": _decontaminate(), "op7_warc": WARC, "op8_line_dedup": _lines(), "op9_quality_rules": _quality()}
