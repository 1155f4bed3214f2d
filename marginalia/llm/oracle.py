"""DuckDB SQL for the operators of this package that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = rf"list_filter(string_split_regex({FOLDED}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
PLAIN = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op5_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, {PLAIN} ws FROM documents), b AS (SELECT item_id, {PLAIN} ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') g FROM (SELECT item_id, ws, least(10, len(ws)) n FROM b WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) i)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') g FROM d CROSS JOIN (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), LATERAL (SELECT unnest(range(i, i + n)) p) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_suffix_dedup": f"""WITH d AS (SELECT doc_id, {SPACED} ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) g FROM d, LATERAL (SELECT unnest(range(0, len(ws) - 49)) i)),
rep AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) k FROM (SELECT *, count(*) OVER (PARTITION BY g) c FROM win) WHERE c > 1),
pos AS (SELECT DISTINCT 1 kind, doc_id, p FROM rep, LATERAL (SELECT unnest(range(i, i + 50)) p) UNION ALL SELECT DISTINCT 2, doc_id, p FROM rep, LATERAL (SELECT unnest(range(i, i + 50)) p) WHERE k > 1),
isl AS (SELECT kind, doc_id, min(p) s, max(p) + 1 e FROM (SELECT *, p - row_number() OVER (PARTITION BY kind, doc_id ORDER BY p) g FROM pos) GROUP BY kind, doc_id, g),
sp AS (SELECT doc_id, kind, sum(e - s) n, string_agg(s || ',' || e, ',' ORDER BY s) x FROM isl GROUP BY 1, 2)
SELECT d.doc_id, len(ws) n_words, CAST(coalesce(a.n, 0) AS BIGINT) n_repeated, CAST(coalesce(b.n, 0) AS BIGINT) n_removed, coalesce(a.x, '') repeated, coalesce(b.x, '') removed
FROM d LEFT JOIN sp a ON a.doc_id = d.doc_id AND a.kind = 1 LEFT JOIN sp b ON b.doc_id = d.doc_id AND b.kind = 2""",
    "op10_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {SPACED} ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: md5(array_to_string(ws[i:i + 3], ' '))))) s FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
link AS (SELECT a.doc_id a, b.doc_id b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id a, doc_id b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a doc_id, min(b) component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept FROM c LEFT JOIN n USING (doc_id)""",
    "op11_filter_audit": rf"""WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM d),
f AS (SELECT part, len(ws) < 50 a, 100 * len(list_distinct(ws)) < 65 * len(ws) b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) c, regexp_matches(t, '[#$%&*|]') d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) e, coalesce(good, 0) good, coalesce(toxic, 0) toxic
  FROM w LEFT JOIN (SELECT doc_id, CAST(max(CAST(quality = 1 AS INTEGER)) AS BIGINT) good, CAST(max(CAST(toxic = 1 AS INTEGER)) AS BIGINT) toxic FROM labels GROUP BY 1) USING (doc_id)),
cell AS (SELECT part, [a, b, c, d, e] x, count(*) n, sum(good) good, sum(toxic) toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] o FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
st AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i AS BIGINT), 1)), '') filter_order, i step, o[1:i - 1] earlier, o[i] own FROM o, l),
m AS (SELECT *, x[own] fails, len(list_filter(earlier, lambda j: x[j])) > 0 gone FROM cell, st),
g AS (SELECT part, filter_order, own, step, sum(n) FILTER (NOT fails AND NOT gone) kept, sum(n) FILTER (fails AND NOT gone) removed, sum(n) FILTER (fails AND gone) redundant, sum(n) FILTER (fails AND len(list_filter(x, lambda y: y)) = 1) unique_fails, sum(good) FILTER (fails AND NOT gone) good_lost, sum(toxic) FILTER (fails AND NOT gone) toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) step, CAST(coalesce(kept, 0) AS BIGINT) kept, CAST(coalesce(removed, 0) AS BIGINT) removed, CAST(coalesce(redundant, 0) AS BIGINT) redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) shapley FROM g""",
}
