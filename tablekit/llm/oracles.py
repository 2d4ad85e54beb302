"""SQL of another engine for the queries that SQL can express. The others have brute-force tests."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All that is reachable from a row of ``rows`` (r, id) by ``links`` (a, b: both ways), and the smallest id of it.
_COMPONENTS = """reach(r, x) AS (SELECT r, r FROM rows UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.x = links.a),
  components AS (SELECT reach.r, min(id) AS component_id FROM reach JOIN rows ON reach.x = rows.r GROUP BY 1)"""

SQL = {
    "op4_vectors": rf"""WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
  usable AS (SELECT * FROM rows WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  {_COMPONENTS}
  SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = rows.r)::BIGINT AS n_links, component_id, id = component_id AS kept
  FROM rows JOIN components USING (r)""",
    "op6_jaccard": rf"""WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, doc_id AS id,
    regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM rows WHERE len(w) > 0)),
  sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY 1),
  shared AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * common >= 90 * (x.n + y.n - common)),
  {_COMPONENTS}
  SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
  FROM rows JOIN components USING (r) LEFT JOIN sizes USING (r)""",
    "op8_warc": """WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
  bits AS (SELECT *, array_to_string(list_transform(range(40), lambda j: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
    '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(h, j + 1, 1))]), '') AS b FROM hashed),
  firsts AS (SELECT payload, min(page_id) AS first FROM hashed GROUP BY 1)
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT
      + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
  FROM bits JOIN firsts USING (payload)""",
    "op10_decontamination": rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  items AS (SELECT item_id, w, least(len(w), 10) AS n
    FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
  runs AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
  hits AS (SELECT DISTINCT r, i, n, item_id FROM runs JOIN windows USING (n, win)),
  hit_words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY 1),
  hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""",
}
