"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import hosts

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_trust(rules=hosts.RULES, damping: float = hosts.DAMPING) -> str:
    def case(field: str) -> str:
        longest = sorted(rules, key=lambda r: -len(r.text))
        return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in longest) + " END"

    host = _LOWER.format(r"regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)")
    link = hosts.LINK.replace("'", "''")
    rounds = hosts.rounds_for(damping=damping)
    sides = ", ".join(f"sum({x}) AS {x}" for x in hosts.SIDES)
    step = "".join(
        f""",
      r{i + 1} AS MATERIALIZED (SELECT kind, node, {sides} FROM (SELECT r.kind, s.dst AS node, {", ".join(f"{damping} * r.{x} * s.share AS {x}" for x in hosts.SIDES)} FROM r{i} r JOIN shares s ON r.kind = s.kind AND r.node = s.src
        UNION ALL SELECT kind, node, {", ".join(f"{1 - damping} * {x}" for x in hosts.SIDES)} FROM r0) GROUP BY ALL)"""
        for i in range(rounds)
    )

    def share(kind: str, *parts: str) -> str:
        ruled, base = ("(" + " + ".join(f"sum({p}{x}) FILTER (kind = '{kind}')" for p in parts) + ")" for x in ("ruled", "base"))
        return f"coalesce({ruled} / nullif({base}, 0), 0)"

    return f"""WITH p0 AS (SELECT page_id, html, coalesce({host.format("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
      p AS (SELECT *, {case("text")} AS rule, {case("verdict")} AS by_rule FROM p0),
      found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS u0 FROM p WHERE host <> ''),
      urls AS (SELECT src, CASE WHEN starts_with(u0, '//') THEN 'http:' || u0 ELSE u0 END AS u FROM found),
      linked AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM (SELECT src, CASE WHEN regexp_matches(u, '{hosts.SCHEME}') THEN {host.format("u")} WHEN starts_with(u, '/') THEN regexp_extract(u, '^(/[^/?#]*)', 1) ELSE '' END AS dst FROM urls) WHERE dst <> '' AND src <> dst GROUP BY ALL),
      rare AS (SELECT dst, ln((SELECT count(DISTINCT host) FROM p WHERE host <> '') / count(*)) AS rarity FROM linked WHERE starts_with(dst, '/') GROUP BY dst HAVING count(*) > 1),
      placed AS (SELECT src, dst, n * rarity AS n FROM linked JOIN rare USING (dst) WHERE rarity > 0),
      parts AS (SELECT DISTINCT string_split(host, '.') AS l FROM p),
      up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM parts)),
      links AS (SELECT 'link' AS way, src, dst, n FROM (SELECT src, dst, n FROM linked WHERE NOT starts_with(dst, '/') UNION ALL SELECT src, dst, n FROM placed UNION ALL SELECT dst, src, n FROM placed)
        UNION ALL SELECT 'tree', src, dst, 1 FROM (FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> '' AND dst <> '' AND src <> dst),
      both_ways AS (SELECT 'allow' AS kind, way, src, dst, n FROM links UNION ALL SELECT 'block', way, dst, src, n FROM links),
      parted AS (SELECT kind, src, dst, way, n / sum(n) OVER (PARTITION BY kind, src, way) AS part FROM both_ways),
      shares AS MATERIALIZED (SELECT kind, src, dst, sum(part / ways) AS share FROM parted JOIN (SELECT kind, src, count(DISTINCT way) AS ways FROM parted GROUP BY ALL) USING (kind, src) GROUP BY ALL),
      hosts AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b, substr(md5(host), 1, 1) < '{hosts.HELD_OUT}' AS held FROM p WHERE host <> '' GROUP BY host),
      seeds AS (SELECT 'allow' AS kind, host AS node, held, a / pages AS w FROM hosts UNION ALL SELECT 'block', host, held, b / pages FROM hosts),
      r0 AS MATERIALIZED (SELECT kind, node, CASE WHEN held THEN 0 ELSE w END AS ruled, CASE WHEN held THEN 0.0 ELSE 1.0 END::DOUBLE AS base, CASE WHEN held THEN w ELSE 0 END AS held_ruled, CASE WHEN held THEN 1.0 ELSE 0.0 END::DOUBLE AS held_base FROM seeds){step},
      sides AS (SELECT node AS host, {share("allow", "", "held_")} AS t, {share("block", "", "held_")} AS d, {share("allow", "")} AS th, {share("block", "")} AS dh FROM r{rounds} GROUP BY node),
      ranks AS MATERIALIZED (SELECT host, CAST(round(100 * (d - t)) AS INT) AS percent, CAST(round(100 * (dh - th)) AS INT) AS held_percent FROM sides),
      tested AS (SELECT coalesce(held_percent, 0) AS q, pages - b AS o, b FROM hosts LEFT JOIN ranks USING (host) WHERE held),
      worth AS (SELECT t, coalesce((SELECT sum(b) FROM tested WHERE q >= t), 0) * (SELECT sum(o) FROM tested) + coalesce((SELECT sum(o) FROM tested WHERE q < t), 0) * (SELECT sum(b) FROM tested) AS w FROM range(1, 102) x(t)),
      chosen AS MATERIALIZED (SELECT CASE WHEN (SELECT coalesce(sum(o), 0) * coalesce(sum(b), 0) FROM tested) = 0 THEN {hosts.PERCENT} ELSE (SELECT t FROM worth ORDER BY w DESC, t DESC LIMIT 1) END AS least)
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN percent >= (SELECT least FROM chosen) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN ranks USING (host)"""


_REACH = """reach(node, other) AS (SELECT a, a FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.other = e.a),
  part AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
  SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
  FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM ends GROUP BY a) USING (vec_id) LEFT JOIN part ON node = vec_id"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
  twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
  covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS doubled
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
  g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 10 * n_words OR 100 * capitals > 60 * word_chars OR 100 * marks > 50 * n_words OR 100 * doubled > 40 * n_words) AS kept FROM g"""

_SAID = r"\### Assistant: </turn> ok"
CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
  c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\<\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g'))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
  SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d),
  x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
  links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
  ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
  SELECT doc_id, len(sh) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN part ON node = doc_id"""

REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
  windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
  later AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM later),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.j = g.j GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

DIVERGENCE = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS t, row_number() OVER () AS r FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) USING (lang, source, term)),
  s AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER v + count(*) OVER v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 1) // (sum(total) OVER v + count(*) OVER v) AS q
    FROM c WINDOW v AS (PARTITION BY lang, source)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  told AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(v, 0) AS BIGINT) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM told)
  SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES = {
    "op1_url_trust": url_trust(),
    "op4_embedding_near_dedup": EMBEDDINGS,
    "op5_quality_cascade": QUALITY,
    "op6_chat_formatting": CHAT,
    "op7_ngram_jaccard": JACCARD,
    "op9_substring_dedup": REPEATS,
    "op11_source_divergence": DIVERGENCE,
}
