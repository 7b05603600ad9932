"""DuckDB SQL for the queries of this package that SQL can express.

None for op1 and op5 (models learned iteratively), op4 (a tokenizer and a
packing), op8 (a pseudo-random shuffle) and the pipeline, which contains two of
them; tests compare those with brute force or check their laws.
"""

from __future__ import annotations

from arealis.llm.licenses import ACROSS, BY_LINE, BY_SENTENCE, RULES, SENTENCES, sequence_of

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _base32(hex_column: str) -> str:
    digits = []
    for g in range(4):
        number = f"('0x' || substr({hex_column}, {g * 10 + 1}, 10))::BIGINT"
        digits += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({number}) >> {35 - 5 * k}) & 31)::INT + 1, 1)" for k in range(8)]
    return " || ".join(digits)


def _licences() -> str:
    table = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
    state = "SELECT doc_id, ids, seq AS seq0, ''::VARCHAR AS hits0 FROM joined"
    for k, (name, ids) in enumerate(RULES):
        pattern = _quoted(sequence_of(ids))
        state = (
            f"SELECT doc_id, ids, replace(seq{k}, {pattern}, '|') AS seq{k + 1}, "
            f"CASE WHEN contains(seq{k}, {pattern}) THEN hits{k} || ',' || {_quoted(name)} ELSE hits{k} END AS hits{k + 1} FROM ({state})"
        )
    n = len(RULES)
    plain = "trim(regexp_replace(lower(s.s), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
    WITH known(sentence, id) AS (VALUES {table}),
    doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spoken AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i
               FROM (SELECT doc_id, regexp_split_to_array(text, {_quoted(BY_SENTENCE)}) AS p FROM doc)),
    read AS (SELECT s.*, k.id FROM spoken s LEFT JOIN known k ON k.sentence = {plain}),
    lines AS (SELECT doc_id, i, unnest(p) AS s, unnest(range(len(p))) AS j
              FROM (SELECT doc_id, i, regexp_split_to_array(s, {_quoted(BY_LINE)}) AS p FROM read WHERE id IS NULL)),
    across AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i
               FROM (SELECT doc_id, regexp_split_to_array(text, {_quoted(BY_LINE)}) AS p FROM doc
                     WHERE regexp_matches(text, '[.!?:][\x0B\f]'))),
    found AS (
      SELECT doc_id, list(id ORDER BY part, i, j) AS ids FROM (
        SELECT doc_id, 0 AS part, i, 0 AS j, id FROM read WHERE id IS NOT NULL
        UNION ALL SELECT doc_id, 0, i, j, k.id FROM lines s JOIN known k ON k.sentence = {plain}
        UNION ALL SELECT doc_id, 1, i, 0, k.id FROM across s JOIN known k ON k.sentence = {plain}
                  WHERE regexp_matches(s, {_quoted(ACROSS)})) GROUP BY 1),
    joined AS (SELECT doc_id, ids, list_reduce(list_prepend('', list_transform(ids, lambda x: ';' || x || ';')), lambda a, b: a || b) AS seq
               FROM found),
    done AS ({state})
    SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences,
           coalesce(array_to_string(ids, ','), '') AS sentence_ids,
           coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(hits{n}, ','), lambda x: x <> ''))), ','), '') AS licences,
           coalesce(len(list_filter(regexp_split_to_array(seq{n}, '[;|]+'), lambda x: x <> '')), 0)::BIGINT AS n_unmatched
    FROM documents d LEFT JOIN done USING (doc_id)
    """


ORACLE: dict[str, str] = {
    "op2_block_naming": """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_warc_normaliser": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    SELECT page_id, strlen(html) AS payload_bytes, {_base32("sha")} AS payload_digest,
           CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p
    """,
    "op6_benchmark_leaks": f"""
    WITH item AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, {_ALPHANUMERIC}) AS w FROM benchmark),
    part AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM part),
    doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_ALPHANUMERIC}) AS w FROM documents),
    lengths AS (SELECT DISTINCT n FROM windows),
    spot AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n),
    seen AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM spot),
    met AS (SELECT doc_id, i, n, item_id FROM seen JOIN windows USING (n, words)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
    items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM met GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_token_group_join": f"""
    WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_SPACED}) AS w FROM documents),
    part AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0),
    shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM part),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
    pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM pair JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * shared >= 85 * (sx.n + sy.n - shared)),
    both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
    reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
    FROM doc d LEFT JOIN size s USING (doc_id) LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY 1) m ON m.x = d.doc_id
    """,
    "op9_sentence_rules": _licences(),
    "op10_tool_calls": """
    WITH RECURSIVE asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    answer AS (SELECT conv_id, turn - 1 AS turn, true AS has, text AS content FROM conversations WHERE role = 'assistant'),
    chain(conv_id, turn, level) AS (
      SELECT conv_id, turn, 0 FROM asked a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
      UNION ALL
      SELECT a.conv_id, a.turn, c.level + 1 FROM chain c JOIN asked a ON a.conv_id = c.conv_id AND a.turn = c.turn + 2)
    SELECT a.conv_id, a.conv_id || ':' || a.turn AS call_id, a.turn AS position, c.level::INT AS level,
           CASE WHEN coalesce(a.text, '') = '' THEN 'invalid' WHEN has THEN 'valid' ELSE 'no_result' END AS status,
           CASE WHEN a.text IS NULL THEN '$: prompt is missing' WHEN a.text = '' THEN '$.prompt: too short' END AS violation,
           '{"arguments":{' || CASE WHEN a.text IS NULL THEN '' ELSE '"prompt":' || to_json(a.text) || ',' END || '"turn":' || a.turn
           || '},"call_id":"' || a.conv_id || ':' || a.turn || '","name":"answer","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
    FROM asked a JOIN chain c USING (conv_id, turn) LEFT JOIN answer USING (conv_id, turn)
    """,
    "op11_difference_cover_anchors": f"""
    WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
    spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50),
    passage AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM spot),
    source AS (SELECT s, min(doc_id) AS low FROM passage GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM passage JOIN source USING (s) WHERE low < doc_id),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc),
    left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM doc LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """,
}
