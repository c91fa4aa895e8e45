"""The relations of the plan in DuckDB SQL, written apart from the Spark code, for checking it."""

from __future__ import annotations

import re

from linkweave.functions.words import ADDRESS_STOPWORDS, LEGAL_SUFFIXES, STOPWORDS


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PUNCT = r"""[.,;:!?"''/\\()\[\]{}<>~`@#$%^*_+=|-]"""


def tokens(clean: str) -> str:
    s = rf"regexp_replace({clean}, '\b([a-zA-Z0-9])\.', '\1', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '&', ' and ', 'g'), '{PUNCT}', ' ', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({s}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


NUM = r"regexp_full_match(t, '\d+')"


def grams(text: str, n: int, short: bool) -> str:
    other = f"CASE WHEN {text} = '' THEN [] ELSE [{text}] END" if short else "[]"
    return f"CASE WHEN length({text}) >= {n} THEN list_distinct(list_transform(range(1, length({text}) - {n} + 2), lambda i: substr({text}, i, {n}))) ELSE {other} END"


_WORDS = f"list_filter(%s, lambda t: NOT {NUM} AND length(t) >= 2)"

CTES = {
    "rec": r"""words AS (SELECT doc_id, lang, n_chars, text, string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '[ \t\n]+', ' ', 'g'), ' ') AS w FROM documents),
rec AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS entity_id,
  array_to_string(w[1:4], ' ') AS business_name,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE CAST(n_chars % 997 AS VARCHAR) || ' ' || array_to_string(w[5:9], ' ') END AS business_address,
  lang AS country, md5(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS k FROM words)""",
    "truth": "truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS tid FROM rec a JOIN rec b ON a.k = b.k WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%')",
    "norm": rf"""norm0 AS (SELECT *, trim(lower(strip_accents(business_name))) AS n_clean, trim(lower(strip_accents(business_address))) AS a_clean,
  regexp_extract_all(business_name, '\b\d+\b') AS n_numbers, regexp_extract_all(business_address, '\b\d+\b') AS a_numbers FROM rec),
norm1 AS (SELECT *, {tokens("n_clean")} AS n_tokens, {tokens("a_clean")} AS a_tokens FROM norm0),
norm AS (SELECT *, array_to_string(n_tokens, ' ') AS n_alnum, array_to_string(a_tokens, ' ') AS a_alnum,
  list_filter(n_tokens, lambda t: list_contains({_list(LEGAL_SUFFIXES)}, t)) AS n_legal,
  list_filter(n_tokens, lambda t: NOT list_contains({_list(LEGAL_SUFFIXES + STOPWORDS)}, t)) AS n_sig,
  list_filter(a_tokens, lambda t: list_contains({_list(LEGAL_SUFFIXES)}, t) OR NOT list_contains({_list(STOPWORDS)}, t)) AS a_sig FROM norm1)""",
    "prof": rf"""prof0 AS (SELECT *, CASE WHEN len(n_sig) > 0 THEN array_to_string(n_sig, ' ') ELSE n_alnum END AS ch1,
  list_sort(CASE WHEN len({_WORDS % "n_sig"}) > 0 THEN {_WORDS % "n_sig"} ELSE {_WORDS % "n_tokens"} END) AS sorted_words,
  list_filter(a_tokens, lambda t: NOT {NUM} AND length(t) >= 3 AND NOT list_contains({_list(ADDRESS_STOPWORDS)}, t)) AS a_words,
  coalesce(regexp_replace(a_numbers[1], '^0+([0-9])', '\1'), '') AS number FROM norm),
prof AS (SELECT *, coalesce(sorted_words[1], '') AS ch2_top1, array_to_string(sorted_words[1:2], '_') AS ch2, array_to_string(sorted_words[1:3], '_') AS ch2_top3,
  CASE WHEN number <> '' AND len(a_words) > 0 THEN number || '_' || a_words[1] ELSE '' END AS ch3,
  CASE WHEN number <> '' AND len(a_words) > 0 THEN number || '_' || a_words[-1] ELSE '' END AS ch4,
  list_distinct(list_filter(n_sig, lambda t: NOT {NUM} AND length(t) >= 3)) AS ch6,
  list_filter(n_sig, lambda t: NOT {NUM} AND length(t) >= 3) AS ch6_all,
  CASE WHEN number = '' THEN [] ELSE list_distinct(list_transform(a_words, lambda t: number || '_' || regexp_replace(t, '([0-9]+)(st|nd|rd|th)$', '\1'))) END AS ch7,
  list_distinct(n_sig) AS f_sig, list_distinct(n_tokens) AS f_tokens, {grams("n_alnum", 2, False)} AS f_char2, {grams("n_alnum", 3, False)} AS f_char3, {grams("n_alnum", 4, False)} AS f_char4,
  list_distinct(a_tokens) AS f_atokens, list_distinct(a_words) AS f_awords, {grams("a_clean", 3, False)} AS f_achar3, list_distinct(a_numbers) AS f_numbers,
  coalesce(a_numbers[1], '') AS f_street, CASE WHEN len(a_numbers) >= 2 THEN a_numbers[-1] ELSE '' END AS f_postal,
  list_distinct(CASE WHEN len(a_tokens) >= 3 THEN a_tokens[-3:] ELSE a_tokens END) AS f_locality,
  regexp_matches(business_name, '[\x{{0900}}-\x{{0D7F}}]') AS f_non_latin, trim(business_address) <> '' AS f_has_address FROM prof0)""",
    "s": "s AS (SELECT * FROM prof WHERE entity_id LIKE 'S1-%')",
    "t": "t AS (SELECT * FROM prof WHERE entity_id NOT LIKE 'S1-%')",
    "keys": """keys AS (SELECT entity_id, 1 AS channel, ch1 AS key FROM prof UNION ALL SELECT entity_id, 2, ch2 FROM prof UNION ALL SELECT entity_id, 3, ch3 FROM prof UNION ALL SELECT entity_id, 4, ch4 FROM prof
  UNION ALL SELECT entity_id, 6, unnest(ch6) FROM prof UNION ALL SELECT entity_id, 7, unnest(ch7) FROM prof)""",
    "idx": "idx AS (SELECT channel, key, entity_id AS tid FROM keys WHERE trim(key) <> '' AND entity_id NOT LIKE 'S1-%')",
    "cap": "cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY tid) AS n FROM idx) WHERE n <= 500)",
    "df6": "df6 AS (SELECT key, count(*) AS df FROM idx WHERE channel = 6 GROUP BY key)",
    "q6": """tok AS (SELECT entity_id AS s1_id, unnest(ch6_all) AS key, unnest(range(len(ch6_all))) AS pos FROM s),
first_tok AS (SELECT s1_id, key, min(pos) AS pos FROM tok GROUP BY ALL),
q6 AS (SELECT * FROM (SELECT f.s1_id, f.key, d.df, row_number() OVER (PARTITION BY f.s1_id ORDER BY d.df, f.pos) AS n FROM first_tok f JOIN df6 d USING (key) WHERE d.df <= 3000))""",
    "exact": """exact AS (SELECT k.entity_id AS s1_id, c.tid, k.channel, 0 AS df FROM keys k JOIN cap c USING (channel, key) WHERE k.entity_id LIKE 'S1-%' AND k.channel <> 6
  UNION ALL SELECT q.s1_id, c.tid, 6, q.df FROM q6 q JOIN cap c ON c.channel = 6 AND c.key = q.key WHERE q.n <= 2)""",
    "post": f"post AS (SELECT entity_id, unnest({grams('ch1', 3, True)}) AS ng, len({grams('ch1', 3, True)}) AS grams FROM prof WHERE ch1 <> '')",
    "idf": "idf AS (SELECT ng, count(*) AS df, ln(1 + (SELECT count(*) FROM t WHERE ch1 <> '') / count(*)) AS idf FROM post WHERE entity_id NOT LIKE 'S1-%' GROUP BY ng)",
    "overlap": """overlap AS (SELECT a.entity_id AS s1_id, b.entity_id AS tid, round(sum(idf), 9) AS score, count(*) AS shared, max(a.grams) AS q_grams, max(b.grams) AS t_grams
  FROM post a JOIN idf USING (ng) JOIN post b USING (ng) WHERE df <= 3000 AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY a.entity_id, b.entity_id)""",
    "ch5": "ch5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tid) AS rank FROM overlap) WHERE rank <= 50)",
    "cand": """cand AS (SELECT s1_id, tid, CAST(bit_or(1 << (channel - 1)) AS INTEGER) AS channel_mask, coalesce(min(CASE WHEN df > 0 THEN df END), 0) AS rarest_token_df, max(score) AS ch5_score, count(DISTINCT channel) AS hits
  FROM (SELECT s1_id, tid, channel, df, 0.0 AS score FROM exact UNION ALL SELECT s1_id, tid, 5, 0, score FROM ch5) GROUP BY s1_id, tid)""",
    "pair": "pair AS (SELECT c.*, s, t FROM cand c JOIN s ON s.entity_id = c.s1_id JOIN t ON t.entity_id = c.tid)",
    "scored": """scored AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tid) AS rank, round(score / 12.5, 9) AS score01 FROM (
  SELECT s1_id, tid, hits, channel_mask, round(CASE WHEN s.n_alnum = t.n_alnum AND s.n_alnum <> '' THEN 3.0 ELSE 0.0 END
   + 2.0 * jac(CASE WHEN len(s.f_sig) > 0 THEN s.f_sig ELSE s.f_tokens END, CASE WHEN len(t.f_sig) > 0 THEN t.f_sig ELSE t.f_tokens END)
   + CASE WHEN len(list_intersect(s.f_numbers, t.f_numbers)) > 0 THEN 2.0 ELSE 0.0 END + 1.5 * jac(s.f_atokens, t.f_atokens) + least(hits, 4), 9) AS score FROM pair))""",
    "decided": "decided AS (SELECT s1_id, tid, score01, rank FROM (SELECT *, max(score01) OVER (PARTITION BY s1_id) AS top FROM scored) WHERE top >= 0.7 AND score01 >= greatest(0.7, top - 0.1))",
    "won": "won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY score01 DESC, s1_id) AS n FROM decided) WHERE n = 1)",
    "per": """per AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM (
  SELECT x.*, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE n_both / n_pred END AS precision, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE n_both / n_true END AS recall FROM (
   SELECT s.entity_id AS s1_id, s.country, (SELECT count(*) FROM truth z WHERE z.s1_id = s.entity_id) AS n_true, (SELECT count(*) FROM won w WHERE w.s1_id = s.entity_id) AS n_pred, (SELECT count(*) FROM won w JOIN truth z ON w.s1_id = z.s1_id AND w.tid = z.tid WHERE w.s1_id = s.entity_id) AS n_both FROM s) x))""",
}

#: What each relation reads.
NEEDS = {
    "rec": [], "truth": ["rec"], "norm": ["rec"], "prof": ["norm"], "s": ["prof"], "t": ["prof"], "keys": ["prof"], "idx": ["keys"], "cap": ["idx"], "df6": ["idx"], "q6": ["s", "df6"],
    "exact": ["cap", "q6"], "post": ["prof"], "idf": ["post", "t"], "overlap": ["idf"], "ch5": ["overlap"], "cand": ["exact", "ch5"], "pair": ["cand", "s", "t"], "scored": ["pair"], "decided": ["scored"], "won": ["decided"], "per": ["won", "truth", "s"],
}


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


def _expanded(sql: str) -> str:
    """``jac(a, b)`` written out."""
    while (at := re.search(r"\bjac\(", sql)) is not None:
        depth, i, comma = 1, at.end(), None
        while depth:
            c = sql[i]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1 and comma is None:
                comma = i
            i += 1
        sql = sql[: at.start()] + jaccard(sql[at.end() : comma].strip(), sql[comma + 1 : i - 1].strip()) + sql[i:]
    return sql


def query(needs: list[str], select: str, more: str = "") -> str:
    """A statement over some of the relations; ``more``: further ones, after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return _expanded("WITH " + ",\n".join([CTES[n] for n in order] + ([more] if more else [])) + "\n" + select)
