"""SQL for the queries that it can express over whole tables in reasonable time."""

from __future__ import annotations

_SPACE = r"[ \t\n\r\f\x0b]+"
_TEXT = rf"trim(regexp_replace(c.text, '{_SPACE}', ' ', 'g'), ' ')"


def _fields(table: str, key: str) -> str:
    """(id, k): the canonical key of each query that has a word."""
    return f"""
        SELECT DISTINCT {key} AS id, array_to_string(list_sort(list_filter(list_transform(
                   string_split_regex(query, '[|;]'),
                   lambda f: lower(array_to_string(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}]+'), ' '))), lambda f: f <> '')), '|') AS k
        FROM {table} WHERE query IS NOT NULL AND {key} IS NOT NULL"""


def _found(table: str, key: str) -> str:
    return f"""
        SELECT '{table}' AS tbl, g.keep_id, r.id AS copy_id FROM ({_fields(table, key)}) r
        JOIN (SELECT k, min(id) AS keep_id FROM ({_fields(table, key)}) GROUP BY k) g USING (k)
        WHERE k <> '' AND r.id <> g.keep_id"""


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def _grams(words: str, n: str) -> str:
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' '))"


#: l: the alike pairs of different chunks, by their distinct triples of words; m: the chunks with a triple.
_NEAR = f"""
    w AS (SELECT DISTINCT id, {_words('text')} AS w FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
    t AS (SELECT DISTINCT id, unnest({_grams('w', '3')}) AS t FROM w), m AS (SELECT id, count(*) AS n FROM t GROUP BY id),
    k AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM t a JOIN t b USING (t) WHERE a.id < b.id GROUP BY ALL),
    l AS (SELECT id_a, id_b FROM k JOIN m a ON a.id = id_a JOIN m b ON b.id = id_b WHERE k.n >= 0.6 * (a.n + b.n - k.n) - 1e-9)"""

#: o: the alike pairs of questions.
_OVERLAP = f"""
    e AS (SELECT DISTINCT qid, list_distinct({_words('query')}) AS w FROM labeled WHERE qid IS NOT NULL AND query IS NOT NULL),
    t AS (SELECT DISTINCT pair_id, list_distinct({_words('query')}) AS w FROM train_pairs WHERE pair_id IS NOT NULL AND query IS NOT NULL),
    o AS (SELECT DISTINCT qid, pair_id FROM (SELECT qid, pair_id, len(e.w) + len(t.w) AS n, len(list_intersect(e.w, t.w)) AS k FROM e JOIN t ON len(e.w) > 0 AND len(t.w) BETWEEN 0.69 * len(e.w) AND len(e.w) / 0.69)
          WHERE k >= 0.7 * (n - k) - 1e-9)"""

#: A document holds a window of 15 words, or all of an item's if it has fewer, side by side.
_LEAKS = f"""
    i AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM eval_passages), d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    f AS (SELECT DISTINCT item_id, unnest({_grams('w', '15')}) AS g FROM i WHERE len(w) >= 15),
    h AS (SELECT DISTINCT doc_id, unnest({_grams('w', '15')}) AS g FROM d WHERE len(w) >= 15),
    found AS (SELECT DISTINCT item_id, doc_id FROM f JOIN h USING (g) UNION SELECT item_id, doc_id
        FROM (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM i WHERE len(w) BETWEEN 1 AND 14) JOIN (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS x FROM d) ON contains(x, s))"""


def _collapsed(table: str, key: str) -> str:
    return f"""
        SELECT '{table}' AS tbl, g.keep_id, t.text, g.n_copies FROM (SELECT min(id) AS keep_id, count(*) AS n_copies FROM ({_fields(table, key)}) WHERE k <> '' GROUP BY k) g
        JOIN (SELECT {key} AS id, min(query) AS text FROM {table} GROUP BY {key}) t ON t.id = g.keep_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_NEAR} SELECT id_a, id_b FROM l",
        # a class is of equal sets of triples; a group is what links reach
        "p1_groups": f"""
            WITH RECURSIVE {_NEAR}, s AS (SELECT id, list_sort(list(t)) AS s FROM t GROUP BY id), c AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM s),
                 b AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM l JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b WHERE x.class_id <> y.class_id),
                 e AS (SELECT a, b FROM b UNION SELECT b, a FROM b), r AS (SELECT DISTINCT class_id AS a, class_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b),
                 g AS (SELECT a, min(root) AS group_id FROM r GROUP BY a)
            SELECT c.id, c.class_id, g.group_id, (SELECT count(*) FROM e WHERE e.a = c.class_id) AS n_links FROM c JOIN g ON g.a = c.class_id""",
        "p2_found": f"WITH {_OVERLAP} SELECT qid, pair_id FROM o",
        "p2_report": f"""
            WITH {_OVERLAP} SELECT split_name, source, coalesce(sum(n), 0)::BIGINT AS n_pairs, count(n) AS n_overlapping, count(*) AS n_records
            FROM labeled LEFT JOIN (SELECT qid, count(*) AS n FROM o GROUP BY qid) USING (qid) GROUP BY ALL""",
        "p3_found": f"""
            SELECT DISTINCT c.id FROM chunks c
            LEFT JOIN chunker_config g ON g.source = string_split(c.source, '#')[1]
            CROSS JOIN (SELECT max_chars FROM chunker_config WHERE source = 'doc') d
            WHERE c.id IS NOT NULL AND strlen({_TEXT}) > coalesce(g.max_chars, d.max_chars)""",
        "p5_found": f"{_found('train_pairs', 'pair_id')} UNION ALL {_found('labeled', 'qid')}",
        "p5_collapsed": f"{_collapsed('train_pairs', 'pair_id')} UNION ALL {_collapsed('labeled', 'qid')}",
        "p7_found": f"WITH {_LEAKS} SELECT item_id, doc_id FROM found",
        "p7_documents": f"WITH {_LEAKS} SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids FROM found GROUP BY doc_id",
        "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
