"""The queries of this package as SQL, where SQL can express them."""

from __future__ import annotations

from . import quality_rules as rules
from . import templates
from .repeated_bytes import DEPTH


def _fence_sql() -> str:
    """Sketch buckets, quantiles per group, language and corpus, and the fences of each group."""
    each = {
        "symbols": "n_symbols * 1000 // greatest(n_words, 1)",
        "lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
        "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
        "length": "word_chars * 100 // greatest(n_words, 1)",
        "words": "n_words",
        "line_count": "n_lines",
    }
    values = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, CAST({v} AS BIGINT) AS v FROM counted" for s, v in each.items())
    levels = {"own": "lang, source", "lan": "lang", "cor": "1 AS every"}
    names = [f"{s}_{q}" for s in each for q in rules.QUANTILES]
    parts = []
    for level, cols in levels.items():
        by = cols.replace("1 AS every", "every")
        picks = ", ".join(
            f"min(CASE WHEN signal = '{s}' AND upto * 100 >= total * {q} THEN bucket END) AS {s}_{q}" for s in each for q in rules.QUANTILES
        )
        parts.append(f"""{level} AS (SELECT {by}, max(total) AS n_docs, {picks} FROM (
            SELECT *, sum(n) OVER (PARTITION BY {by}, signal) AS total,
                   sum(n) OVER (PARTITION BY {by}, signal ORDER BY bucket) AS upto
            FROM (SELECT {cols}, signal, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {by})""")
    above = ", ".join(f"CASE WHEN lan.n_docs >= {rules.MIN_GROUP} THEN lan.{c} ELSE cor.{c} END AS up_{c}" for c in names)
    chosen = ", ".join(f"CASE WHEN n_docs >= {rules.MIN_GROUP} THEN {c} ELSE up_{c} END AS {c}" for c in names)

    def room(s: str, median: int, quartile: int, tail: int) -> str:
        apart = lambda a, b, mark="": f"abs({mark}{s}_{a} - {mark}{s}_{b})"
        if s in rules.LEAST:
            count, size = rules.LEAST[s]
            least = f"({1000 * count} // greatest({size}_25, 1))"
        else:
            least = f"({s}_{median} // {2 ** (rules.BITS - 1)})"
        thin = f"least({apart(tail, quartile)}, {apart(tail, quartile, 'up_')})"
        return f"greatest({apart(quartile, median)} * {rules.MIDDLE} // 100, {thin} * {rules.TAIL} // 100, {least} * {rules.SCALE} // 100)"

    tops = ", ".join(f"CAST({s}_75 + {room(s, 50, 75, 90)} AS BIGINT) AS max_{s}" for s in rules.SIGNALS)
    return f"""valued AS ({values}),
        sketch AS (SELECT lang, source, signal, (v >> cut) << cut AS bucket, count(*) AS n FROM (
            SELECT *, CAST(greatest(length(bin(v)) - {rules.BITS}, 0) AS INTEGER) AS cut FROM valued) GROUP BY ALL),
        {", ".join(parts)},
        levelled AS (SELECT own.*, {above} FROM own JOIN lan ON own.lang IS NOT DISTINCT FROM lan.lang CROSS JOIN cor),
        fences AS (SELECT lang, source, {tops}, CAST(length_25 - {room("length", 50, 25, 10)} AS BIGINT) AS min_length
            FROM (SELECT lang, source, {chosen}, {", ".join(f"up_{c}" for c in names)} FROM levelled))"""


def quality_rules_sql() -> str:
    word = "[^ \\x09-\\x0D]+"
    inside = " AND ".join(
        f"{v} <= max_{s}"
        for s, v in {
            "symbols": "n_symbols * 1000 // greatest(n_words, 1)",
            "lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
            "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
            "length": "word_chars * 100 // greatest(n_words, 1)",
        }.items()
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{word}') AS w,
                 [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{word}')] AS l FROM docs),
windows AS (SELECT r, i, array_to_string(w[i + 1 : i + 3], ' ') AS s
            FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM words WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (SELECT words.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
    FROM words LEFT JOIN covered ON words.r = covered.r),
{_fence_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {inside}
       AND word_chars * 100 // greatest(n_words, 1) >= min_length AS kept,
       max_symbols, max_lines, max_repeats, max_length, min_length
FROM (SELECT *, n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {rules.MAX_REPEAT} AS base_failed FROM counted) d
JOIN fences f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source"""


CHAT_SNAPSHOTS = """
WITH told AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
copies AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_copies FROM told GROUP BY t),
earlier AS (SELECT DISTINCT t[1:k] AS p FROM (SELECT t, unnest(range(1, len(t))) AS k FROM told))
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, n_copies,
  array_to_string(['<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' FOR x IN t], chr(10)) AS text
FROM copies LEFT JOIN earlier ON t = p WHERE p IS NULL"""

LINE_CHUNKS = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text, substr(md5(text), 1, 15) AS th, string_split(text, chr(10)) AS lines FROM documents),
cut AS (SELECT d, doc_id, th, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs),
solid AS (SELECT d, doc_id, th, i, lines[i] AS x, row_number() OVER (PARTITION BY d ORDER BY i) AS k
    FROM cut WHERE regexp_matches(lines[i], '[^ \x09-\x0D]')),
chunks AS (SELECT *, lead(x) OVER (PARTITION BY d ORDER BY k) AS y FROM solid),
judged AS (SELECT d, k, (doc_id, th, k) <> first_value((doc_id, th, k)) OVER (PARTITION BY x, y ORDER BY doc_id NULLS FIRST, th, k) AS again
    FROM chunks WHERE y IS NOT NULL),
gone AS (SELECT DISTINCT d, k + j AS k FROM judged, (SELECT unnest([0, 1]) AS j) WHERE again),
runs AS (SELECT d, count(*) AS lines_gone, count(*) FILTER (before IS NULL OR before < k - 1) AS chunks_gone
    FROM (SELECT *, lag(k) OVER (PARTITION BY d ORDER BY k) AS before FROM gone) GROUP BY d),
kept AS (SELECT cut.d, string_agg(lines[cut.i], chr(10) ORDER BY cut.i) AS t FROM cut LEFT JOIN solid ON solid.d = cut.d AND solid.i = cut.i
    LEFT JOIN gone ON gone.d = cut.d AND gone.k = solid.k WHERE gone.d IS NULL GROUP BY cut.d)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(lines_gone, 0) AS BIGINT) AS n_removed_lines,
  CAST(coalesce(chunks_gone, 0) AS BIGINT) AS n_removed_chunks, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text
FROM docs LEFT JOIN runs ON runs.d = docs.d LEFT JOIN kept ON kept.d = docs.d"""

RANKED_SEARCH = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents),
held AS (SELECT r, doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM docs GROUP BY ALL),
sized AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY r),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS HUGEINT) AS n_terms FROM sized),
normal AS (SELECT r, CAST(10 + (90 * n * n_docs) // n_terms AS BIGINT) AS m FROM sized, corpus),
asked AS (SELECT DISTINCT item_id, text, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT item_id, text, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark)),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
scored AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN normal USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10"""

FILTER_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
read AS (SELECT *, regexp_extract_all(t, '[^ \x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
        WHEN 'A' THEN len(w) < 50 WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
        WHEN 'C' THEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t)
        WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(read.doc_id > least, false) END) AS fails
    FROM read LEFT JOIN marks ON read.doc_id = marks.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, o[step] AS own, o[1 : step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, o, step, own, n, good, toxic, list_contains(fails, own) AS hit, list_has_any(fails, earlier) AS gone, len(fails) AS many FROM cells, steps),
summed AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND many = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed"""


NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
sets AS (SELECT doc_id, text, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END)) AS s FROM split),
numbered AS (SELECT doc_id, s, dense_rank() OVER (ORDER BY s, CASE WHEN len(s) = 0 THEN doc_id END, CASE WHEN len(s) = 0 THEN text END) AS c FROM sets),
classes AS (SELECT c, any_value(s) AS s, min(doc_id) AS least, count(*) AS n_copies FROM numbered GROUP BY c),
shingles AS (SELECT c, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS (SELECT x.c AS a, y.c AS b FROM shingles x JOIN shingles y USING (shingle) WHERE x.c <> y.c
    GROUP BY x.c, y.c HAVING 9 * count(*) >= 4 * (min(x.n) + min(y.n))),
reached AS (SELECT DISTINCT a AS c, a AS other FROM links UNION SELECT b, other FROM reached JOIN links ON a = c),
groups AS (SELECT reached.c, min(least) AS least FROM reached JOIN classes ON classes.c = other GROUP BY reached.c),
degrees AS (SELECT a AS c, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(groups.least, classes.least) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(n_copies AS BIGINT) AS n_copies
FROM numbered JOIN classes USING (c) LEFT JOIN groups USING (c) LEFT JOIN degrees USING (c)"""


def repeated_bytes_sql() -> str:
    """Byte strings get ranks by length, each length from two shorter strings; 200 is two of 128 that overlap."""
    steps, length = [], 1
    for gap in (1, 2, 4, 8, 16, 32, 64, DEPTH - 128):
        pair = f"SELECT r, place, h, lead(h, {gap}) OVER (PARTITION BY r ORDER BY place) AS g FROM of_{length}"
        steps.append(f"of_{length + gap} AS (SELECT r, place, dense_rank() OVER (ORDER BY h, g) AS h FROM ({pair}) WHERE g IS NOT NULL)")
        length += gap
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data FROM documents),
hexed AS (SELECT r, regexp_extract_all(hex(data), '..') AS x FROM docs),
of_1 AS (SELECT r, unnest(range(len(x))) AS place, unnest(x) AS h FROM hexed),
{", ".join(steps)},
starts AS (SELECT r, place, count(*) OVER (PARTITION BY h) > 1 AS twice FROM of_{DEPTH}),
covered AS (SELECT r, place, h, coalesce(bool_or(twice) OVER (PARTITION BY r ORDER BY place ROWS {DEPTH - 1} PRECEDING), false) AS gone
    FROM of_1 LEFT JOIN starts USING (r, place)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY place), false) AS opens FROM covered),
summed AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(h, '' ORDER BY place) FILTER (NOT gone), '') AS kept FROM edges GROUP BY r)
SELECT doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM docs LEFT JOIN summed USING (r)"""


def templates_sql() -> str:
    """Tokens and templates step by step, every window of both sides, equal templates and consistent slots."""
    name, point = "chr(1)", "chr(2)"

    def tokens(rows: str) -> str:
        marked = f"translate(coalesce(text, ''), {name} || {point}, '  ')"
        marked = rf"regexp_replace({marked}, '([\p{{Ll}}\p{{N}},;])\s+(\p{{Lu}})', '\1 ' || {name} || '\2', 'g')"
        for _ in range(2):  # 1,2,3: the digits between are taken by the first turn
            marked = rf"regexp_replace({marked}, '(\p{{Nd}})[.,](\p{{Nd}})', '\1' || {point} || '\2', 'g')"
        marked = rf"regexp_replace({marked}, '[^\p{{L}}\p{{M}}\p{{N}}' || {name} || {point} || ']+', ' ', 'g')"
        for pair in (r"(\p{Nd})(\p{L})", r"(\p{L})(\p{Nd})"):
            marked = rf"regexp_replace({marked}, '{pair}', '\1 \2', 'g')"
        return f"SELECT *, list_filter(string_split(lower(trim({marked})), ' '), lambda x: x <> '') AS raw FROM ({rows})"

    shape = rf"CASE WHEN x[1] = {name} AND len(x) > 1 THEN '<name>' WHEN regexp_full_match(x, '\p{{Nd}}[\p{{Nd}}' || {point} || ']*') THEN '<num>' ELSE x END"
    units = ", ".join(f"'{unit}'" for unit in templates.UNITS)

    def shaped(rows: str) -> str:
        once = f"SELECT *, list_transform(raw, lambda x: {shape}) AS s FROM ({tokens(rows)})"
        unit = f"CASE WHEN k > 1 AND s[k - 1] = '<num>' AND s[k] IN ({units}) THEN '<unit>' ELSE s[k] END"
        return f"SELECT * EXCLUDE (s), list_transform(range(1, len(s) + 1), lambda k: {unit}) AS template FROM ({once})"

    size, least = templates.WINDOW, templates.SHORTEST
    slots = "list_filter(range(1, size + 1), lambda k: starts_with(template[k], '<'))"
    return f"""
WITH docs AS ({shaped("SELECT DISTINCT doc_id, text FROM documents")}),
whole AS ({shaped("SELECT item_id, text FROM benchmark")}),
quoted AS ({shaped("SELECT item_id, 'a ' || text AS text FROM benchmark")}),
items AS (SELECT item_id, raw, template FROM whole UNION ALL SELECT item_id, raw[2:], template[2:] FROM quoted),
sized AS (SELECT *, least(len(template), {size}) AS size FROM items WHERE len(template) >= {least}),
started AS (SELECT *, unnest(range(len(template) - size + 1)) AS spot FROM sized),
cut AS (SELECT DISTINCT item_id, spot, size, raw[spot + 1 : spot + size] AS i_raw, template[spot + 1 : spot + size] AS template FROM started),
known AS (SELECT * FROM cut WHERE len(list_filter(template, lambda x: NOT starts_with(x, '<'))) >= {templates.LITERALS}),
sizes AS (SELECT DISTINCT size FROM known),
places AS (SELECT doc_id, text, raw, template, size, unnest(range(len(template) - size + 1)) AS start FROM docs, sizes WHERE len(template) >= size),
spelt AS (SELECT doc_id, text, start, raw[start + 1 : start + size] AS raw, template[start + 1 : start + size] AS template FROM places),
met AS (SELECT *, {slots} AS slots FROM spelt JOIN known USING (template)),
fitting AS (SELECT * FROM met WHERE len(list_distinct(list_transform(slots, lambda k: [template[k], i_raw[k]])))
    = len(list_distinct(list_transform(slots, lambda k: [template[k], i_raw[k], raw[k]]))))
SELECT doc_id, item_id, count(DISTINCT spot) AS n_windows, min(start) AS first_token, bool_or(raw <> i_raw) AS reparameterised
FROM fitting GROUP BY doc_id, text, item_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_snapshots": CHAT_SNAPSHOTS,
        "op4_near_duplicates": NEAR_DUPLICATES,
        "op6_line_chunks": LINE_CHUNKS,
        "op7_templates": templates_sql(),
        "op9_repeated_bytes": repeated_bytes_sql(),
        "op10_quality_rules": quality_rules_sql(),
        "op11_ranked_search": RANKED_SEARCH,
        "op13_filter_audit": FILTER_AUDIT,
    }
