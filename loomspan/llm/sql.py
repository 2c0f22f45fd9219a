"""DuckDB's text of the pN_ queries that SQL can express on whole tables.

The others (automata, tilings, classifiers, ordered rules, hashed identities) are tested
against brute force, p1 and p3 here are too.
"""

from __future__ import annotations

_SPACE = r"[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z}]"
_BOUNDARY = r"[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z},.;:!?、。，；：！？]"


def _core(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _windows(c: str, k: str | int) -> str:
    return f"list_transform(range(1, length({c}) - {k} + 2), lambda p: substring({c}, p, {k}))"


def _similar(least: float) -> str:
    common = "len(list_intersect(a.w, b.w))"
    return f"{common} > 0 AND {common} >= {least} * (len(a.w) + len(b.w) - {common})"


_RECORDS = (
    "r AS (SELECT DISTINCT * FROM (SELECT 'minilongbench_tiny' AS source_table, id || '_' || e.doc_id AS key, e.text AS text FROM (SELECT id, unnest(documents) AS e FROM minilongbench_tiny) UNION ALL SELECT 'corpus_chunks', chunk_id, text FROM corpus_chunks) WHERE key IS NOT NULL)"
)
_OVERLAPS = (
    r"s AS (SELECT id, regexp_extract(id, '_(train|valid|test)_\d+$', 1) AS split, arg_max(question, prepared_at) AS question FROM minilongbench_tiny WHERE id IS NOT NULL GROUP BY id), "
    f"q AS (SELECT id, split, list_distinct({_windows(_core('question'), 3)}) AS w FROM s WHERE question IS NOT NULL AND split <> ''), "
    f"pq AS (SELECT a.id AS t, b.id AS h FROM q a JOIN q b ON a.split = 'train' AND b.split <> 'train' AND {_similar(0.5)}), "
    "x AS (SELECT DISTINCT id, e.text AS text FROM (SELECT id, unnest(documents) AS e FROM minilongbench_tiny)), "
    f"k AS (SELECT id, list_distinct({_windows('c', 8)}) AS w FROM (SELECT id, {_core('text')} AS c FROM x) WHERE length(c) >= 100), "
    f"pairs AS (SELECT DISTINCT t, h FROM pq JOIN k a ON a.id = t JOIN k b ON b.id = h WHERE {_similar(0.6)})"
)

SQL: dict[str, str] = {
    "p1_found": (
        f"WITH {_RECORDS}, f AS (SELECT source_table, key, {_core('text')} AS c FROM r), w AS (SELECT DISTINCT source_table, key, unnest({_windows('c', 8)}) AS w FROM f WHERE length(c) >= 100), n AS (SELECT source_table, key, count(*) AS n FROM w GROUP BY ALL), "
        "p AS (SELECT a.source_table, a.key AS key_a, b.key AS key_b, count(*) AS common FROM w a JOIN w b ON a.source_table = b.source_table AND a.w = b.w AND a.key < b.key GROUP BY ALL) "
        "SELECT p.source_table, key_a, key_b FROM p JOIN n a ON a.source_table = p.source_table AND a.key = key_a JOIN n b ON b.source_table = p.source_table AND b.key = key_b WHERE common >= 0.6 * (a.n + b.n - common)"
    ),
    "p2_found": (
        "WITH e AS (SELECT id, unnest(documents) AS e FROM minilongbench_tiny), "
        "items AS (SELECT 'minilongbench_tiny' AS source_table, id AS sample_id, e.doc_id AS item_id, length(e.text) AS size, 1200 AS most, e.text AS text FROM e UNION ALL "
        "SELECT 'corpus_chunks', sample_id, chunk_id, coalesce(offset_end - offset_start, length(text)), 512, text FROM corpus_chunks) "
        f"SELECT DISTINCT source_table, sample_id, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '{_BOUNDARY}'), lambda s: length(s))) > most THEN 'forced' ELSE 'natural' END AS cut_kind FROM items WHERE size > most AND text IS NOT NULL"
    ),
    "p3_found": f"WITH {_OVERLAPS} SELECT least(t, h) AS id_a, greatest(t, h) AS id_b FROM pairs",
    "p3_report": (
        f"WITH {_OVERLAPS}, o AS (SELECT id, max(coalesce(nullif(lower(regexp_replace(meta['dataset'], '^{_SPACE}+|{_SPACE}+$', '', 'g')), ''), 'unknown')) AS source FROM minilongbench_tiny GROUP BY id), "
        "held AS (SELECT o.id, split, source FROM o JOIN s USING (id) WHERE split IN ('valid', 'test')) "
        "SELECT split, source, count(DISTINCT held.id) AS n_samples, count(t) AS n_pairs, count(DISTINCT h) AS n_overlapping, count(DISTINCT t) AS n_train_samples FROM held LEFT JOIN pairs ON h = held.id GROUP BY split, source"
    ),
    "p7_found": (
        f"WITH d AS (SELECT doc_id, {_core('text')} AS c FROM documents), i AS (SELECT item_id, CASE WHEN starts_with(lower(trim(lang)), 'zh') THEN 20 ELSE 50 END AS k, unnest([passage, question]) AS t FROM eval_items), ic AS (SELECT item_id, k, {_core('t')} AS c FROM i), "
        f"iw AS (SELECT DISTINCT item_id, k, unnest({_windows('c', 'k')}) AS w FROM ic WHERE length(c) >= k), dw AS (SELECT DISTINCT doc_id, k, unnest({_windows('c', 'k')}) AS w FROM d, (VALUES (20), (50)) v(k) WHERE length(c) >= k) "
        "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k, w)"
    ),
}
