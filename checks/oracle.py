"""The same queries as SQL over the same tables, for an independent engine."""

from __future__ import annotations

from topicflow.functions.text import ENGLISH_STOP_WORDS

PATTERN = r"[\p{L}\p{N}_]{2,}"
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(ENGLISH_STOP_WORDS)))

# --- shared pieces, in dependency order ---------------------------------------

TOK = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM documents)"""

DTC = """
dtc AS (SELECT doc_id, term, count(*) AS cnt FROM tok{where} GROUP BY doc_id, term)"""

VOCAB = """
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, tf
  FROM (SELECT term, CAST(sum(cnt) AS BIGINT) AS tf FROM dtc GROUP BY term
        ORDER BY tf DESC, term LIMIT 500))"""

SLICED = """
pos AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
               count(*) OVER () AS n FROM documents),
sliced AS (SELECT doc_id, lang, source,
                  CAST(least(pos // (n // 5), 4) AS INTEGER) AS slice_id FROM pos),
sizes AS (SELECT slice_id, count(*) AS n_docs FROM sliced GROUP BY slice_id)"""

DTM = """
dtm AS (SELECT s.slice_id, d.doc_id, v.term_id, d.cnt, s.lang, s.source
        FROM dtc d JOIN vocab v USING (term) JOIN sliced s USING (doc_id))"""

TW = """
counts AS (
  SELECT slice_id,
         CAST((CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END
               + slice_id) % 4 AS INTEGER) AS topic_id,
         term_id, CAST(sum(cnt) AS DOUBLE) AS lam
  FROM dtm GROUP BY slice_id, lang, term_id),
tw AS (SELECT slice_id, topic_id, term_id,
              lam / sum(lam) OVER (PARTITION BY slice_id, topic_id) AS p FROM counts)"""

TOP = """
ranked AS (SELECT slice_id, topic_id, term_id, p,
                  row_number() OVER (PARTITION BY slice_id, topic_id
                                     ORDER BY p DESC, term_id DESC) AS rank FROM tw),
top AS (SELECT * FROM ranked WHERE rank <= 10)"""

NPMI = """
df AS (SELECT slice_id, term_id, count(*) AS n_docs FROM dtm GROUP BY slice_id, term_id),
pairs AS (SELECT a.slice_id, a.topic_id, a.term_id AS term_i, b.term_id AS term_j
          FROM top a JOIN top b ON a.slice_id = b.slice_id AND a.topic_id = b.topic_id
                                AND a.term_id < b.term_id),
wanted AS (SELECT DISTINCT slice_id, term_i, term_j FROM pairs),
co AS (SELECT w.slice_id, w.term_i, w.term_j, count(*) AS n_docs
       FROM wanted w JOIN dtm x ON x.slice_id = w.slice_id AND x.term_id = w.term_i
                     JOIN dtm y ON y.slice_id = w.slice_id AND y.doc_id = x.doc_id
                               AND y.term_id = w.term_j
       GROUP BY w.slice_id, w.term_i, w.term_j),
probs AS (SELECT p.slice_id, p.topic_id, p.term_i, p.term_j,
                 (coalesce(di.n_docs, 0) + 1e-12) / s.n_docs AS p_i,
                 (coalesce(dj.n_docs, 0) + 1e-12) / s.n_docs AS p_j,
                 CAST(coalesce(c.n_docs, 0) AS DOUBLE) / s.n_docs AS p_ij
          FROM pairs p JOIN sizes s USING (slice_id)
          LEFT JOIN df di ON di.slice_id = p.slice_id AND di.term_id = p.term_i
          LEFT JOIN df dj ON dj.slice_id = p.slice_id AND dj.term_id = p.term_j
          LEFT JOIN co c ON c.slice_id = p.slice_id AND c.term_i = p.term_i
                        AND c.term_j = p.term_j),
npmi AS (SELECT slice_id, topic_id, term_i, term_j,
                ln(CASE WHEN p_ij > 0 THEN p_ij / (p_i * p_j) ELSE 1.0 END)
                / -ln(p_ij + 1e-12) AS npmi FROM probs)"""

COHERENCE = """
coherence AS (SELECT slice_id, avg(c) AS coherence
              FROM (SELECT slice_id, topic_id, avg(npmi) AS c FROM npmi GROUP BY slice_id, topic_id)
              GROUP BY slice_id)"""

COSINE = """
norms AS (SELECT slice_id, topic_id, sqrt(sum(p * p)) + 1e-16 AS norm FROM tw
          GROUP BY slice_id, topic_id),
dots AS (SELECT a.slice_id, a.topic_id AS src_topic, b.topic_id AS tgt_topic, sum(a.p * b.p) AS dot
         FROM tw a JOIN tw b ON b.slice_id = a.slice_id + 1 AND b.term_id = a.term_id
         GROUP BY a.slice_id, a.topic_id, b.topic_id),
cosine AS (SELECT a.slice_id, a.topic_id AS src_topic, b.topic_id AS tgt_topic,
                  coalesce(d.dot, 0) / (a.norm * b.norm) AS similarity
           FROM norms a JOIN norms b ON b.slice_id = a.slice_id + 1
           LEFT JOIN dots d ON d.slice_id = a.slice_id AND d.src_topic = a.topic_id
                           AND d.tgt_topic = b.topic_id),
cost AS (SELECT slice_id, src_topic, tgt_topic, 1 - similarity AS cost FROM cosine)"""

# all 24 one-to-one maps of four topics, the cheapest per slice pair
MATCH = """
perms AS (SELECT a.i AS m0, b.i AS m1, c.i AS m2, d.i AS m3
          FROM range(4) a(i), range(4) b(i), range(4) c(i), range(4) d(i)
          WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
totals AS (SELECT c.slice_id, m0, m1, m2, m3, sum(c.cost) AS total
           FROM perms JOIN cost c ON c.tgt_topic = CASE c.src_topic WHEN 0 THEN m0 WHEN 1 THEN m1
                                                   WHEN 2 THEN m2 ELSE m3 END
           GROUP BY c.slice_id, m0, m1, m2, m3),
best AS (SELECT slice_id, arg_min([m0, m1, m2, m3], total) AS m FROM totals GROUP BY slice_id),
matching AS (SELECT slice_id, CAST(unnest(range(4)) AS INTEGER) AS src_topic,
                 CAST(unnest(m) AS INTEGER) AS tgt_topic FROM best)"""

TRACKS = """
tracks AS (
  SELECT 0 AS slice_id, CAST(i AS INTEGER) AS track_id, CAST(i AS INTEGER) AS topic_id FROM range(4) r(i)
  UNION ALL
  SELECT t.slice_id + 1, t.track_id, m.tgt_topic
  FROM tracks t JOIN matching m ON m.slice_id = t.slice_id AND m.src_topic = t.topic_id),
aligned AS (SELECT slice_id, track_id, term_id, p FROM tw JOIN tracks USING (slice_id, topic_id))"""

DRIFT = """
two AS (SELECT coalesce(a.slice_id, b.slice_id - 1) AS slice_id,
               coalesce(a.track_id, b.track_id) AS track_id,
               coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q
        FROM (SELECT * FROM aligned WHERE slice_id < 4) a
        FULL OUTER JOIN (SELECT * FROM aligned WHERE slice_id > 0) b
          ON b.slice_id = a.slice_id + 1 AND b.track_id = a.track_id AND b.term_id = a.term_id),
drift AS (SELECT slice_id, track_id,
                 sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2,
                               0)) AS js_distance
          FROM two GROUP BY slice_id, track_id)"""

ALIGNMENT = """
alignment AS (SELECT slice_id, avg(best) AS alignment
              FROM (SELECT slice_id, src_topic, max(similarity) AS best FROM cosine
                    GROUP BY slice_id, src_topic) GROUP BY slice_id)"""


def build(*parts: str, select: str, stop: bool = False) -> str:
    where = f" WHERE term NOT IN ({STOP})" if stop else ""
    return "WITH RECURSIVE" + ",".join(parts).replace("{where}", where) + "\n" + select


BASE = (TOK, DTC, VOCAB, SLICED, DTM)
TOPICS = (*BASE, TW)
TRACKED = (*TOPICS, COSINE, MATCH, TRACKS)

SUMMARY = build(
    *TOPICS, TOP, NPMI, COHERENCE, COSINE, MATCH, TRACKS, DRIFT, ALIGNMENT,
    select="""SELECT 5 AS n_slices, 4 AS n_topics, 500 AS max_features,
  (SELECT round(avg(coherence), 6) FROM coherence) AS avg_coherence,
  (SELECT round(avg(d), 6) FROM (SELECT count(DISTINCT term_id) / 40.0 AS d FROM top
                                 GROUP BY slice_id)) AS avg_diversity,
  (SELECT round(1 - avg(js_distance), 6) FROM drift) AS evolution_smoothness,
  (SELECT round(avg(alignment), 6) FROM alignment) AS avg_alignment,
  CAST(NULL AS DOUBLE) AS avg_perplexity""",
)

# the blank line, the footer rule and the quote rule, written with list functions
STRIP_MAIL = r"""
WITH mail AS (
  SELECT doc_id, 'From: x' || chr(10) || 'Subject: y' || chr(10) || chr(10) || text || chr(10) || '> '
                 || source || chr(10) || chr(10) || '--' || chr(10) || lang AS text FROM documents),
body AS (SELECT doc_id, CASE WHEN instr(text, chr(10) || chr(10)) > 0
                THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE '' END AS text FROM mail),
lined AS (SELECT doc_id, text, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS lines
          FROM body),
cut AS (SELECT doc_id, text, lines, len(lines) - coalesce(list_position(
          list_reverse(list_transform(lines, lambda x: regexp_matches(x, '^\s*-*\s*$'))), true), 0) AS cut,
          list_contains(list_transform(lines, lambda x: regexp_matches(x, '^\s*-*\s*$')), true) AS has_rule
        FROM lined),
footed AS (SELECT doc_id, CASE WHEN has_rule AND cut > 0 THEN array_to_string(lines[1:cut], chr(10))
                          ELSE text END AS text FROM cut)
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x,
  '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)')), chr(10)) AS text
FROM footed"""

EVENT_TOKENS = f"""
ev AS (SELECT event_id AS doc_id, ts, lower(event_type || ' ' || props) AS text FROM events),
etok AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PATTERN}')) AS term FROM ev),
tok AS (SELECT * FROM etok WHERE term NOT IN ({STOP})),
dtc AS (SELECT doc_id, term, count(*) AS cnt FROM tok GROUP BY doc_id, term)"""

# up to 200 scaling rounds over lists, one row per slice pair; a pair stops when u moves less than 1e-9
SINKHORN = """
mass AS (SELECT slice_id, topic_id, sum(lam) AS w FROM counts GROUP BY slice_id, topic_id),
share AS (SELECT slice_id, topic_id, {weight} / sum({weight}) OVER (PARTITION BY slice_id) AS w FROM mass),
kernel AS (SELECT slice_id AS problem, src_topic AS i, tgt_topic AS j, cost AS c,
                  exp(-cost / 0.01) + 1e-16 AS k FROM cost),
by_row AS (SELECT problem, list(r ORDER BY i) AS m
           FROM (SELECT problem, i, list(k ORDER BY j) AS r FROM kernel GROUP BY problem, i) GROUP BY problem),
by_col AS (SELECT problem, list(r ORDER BY j) AS m
           FROM (SELECT problem, j, list(k ORDER BY i) AS r FROM kernel GROUP BY problem, j) GROUP BY problem),
sides AS (SELECT slice_id, list(w ORDER BY topic_id) AS w FROM share GROUP BY slice_id),
prob AS (SELECT r.problem, r.m AS rows, c.m AS cols, a.w AS a, b.w AS b
         FROM by_row r JOIN by_col c USING (problem)
         JOIN sides a ON a.slice_id = r.problem JOIN sides b ON b.slice_id = r.problem + 1),
sink AS (
  SELECT problem, 0 AS it, [1.0::DOUBLE, 1, 1, 1] AS u, [1.0::DOUBLE, 1, 1, 1] AS v, 'inf'::DOUBLE AS moved FROM prob
  UNION ALL
  SELECT problem, it + 1, u2,
         list_transform(range(1, 5), lambda j: b[j] / list_dot_product(cols[j], u2)), list_distance(u, u2)
  FROM (SELECT s.problem, it, cols, b, u,
               list_transform(range(1, 5), lambda i: a[i] / list_dot_product(rows[i], v)) AS u2
        FROM sink s JOIN prob p ON p.problem = s.problem WHERE it < 200 AND NOT moved < 1e-9)),
plan AS (SELECT k.problem, k.i, k.j, k.c, s.u[k.i + 1] * s.v[k.j + 1] * k.k AS gamma
         FROM kernel k JOIN (SELECT problem, arg_max(u, it) AS u, arg_max(v, it) AS v FROM sink GROUP BY problem) s
           ON s.problem = k.problem)"""
WEIGHTED = SINKHORN.replace("{weight}", "w")
UNIFORM = SINKHORN.replace("{weight}", "1.0::DOUBLE")

# Prim's algorithm, one step per row of the recursion; the state is three lists
TREE = """
pts AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS idx
        FROM embeddings),
dist AS MATERIALIZED (SELECT x.idx, list(list_distance(x.e, y.e) ORDER BY y.idx) AS ds FROM pts x, pts y GROUP BY x.idx),
size AS (SELECT count(*) AS n FROM pts),
prim AS (
  SELECT 0::BIGINT AS step, 1::BIGINT AS cur, list_transform(range(1, n + 1), lambda i: i < 0) AS used,
         list_transform(range(1, n + 1), lambda i: 'inf'::DOUBLE) AS best,
         list_transform(range(1, n + 1), lambda i: 0::BIGINT) AS link,
         0::BIGINT AS a, 0::BIGINT AS b, 0::DOUBLE AS h FROM size
  UNION ALL
  SELECT step + 1, nxt, used2, best2, link2, least(nxt, link2[nxt]), greatest(nxt, link2[nxt]), best2[nxt]
  FROM (SELECT *, list_position(open, list_min(open)) AS nxt
    FROM (SELECT *, list_transform(range(1, n + 1), lambda i:
                      CASE WHEN used2[i] THEN 'inf'::DOUBLE ELSE best2[i] END) AS open
      FROM (SELECT step, n,
              list_transform(range(1, n + 1), lambda i: used[i] OR i = cur) AS used2,
              list_transform(range(1, n + 1), lambda i: least(best[i], ds[i])) AS best2,
              list_transform(range(1, n + 1), lambda i: CASE WHEN ds[i] < best[i] THEN cur ELSE link[i] END) AS link2
            FROM prim JOIN dist ON dist.idx = cur, size WHERE step < n - 1)))),
tree AS (SELECT a, b, h, row_number() OVER (ORDER BY h, a, b) AS ord FROM prim WHERE step > 0)"""

# apply the chosen tree edges one by one to a list of labels
CUT = """
kept AS (SELECT a, b, row_number() OVER (ORDER BY ord) AS ord FROM tree WHERE {cut}),
total AS (SELECT count(*) AS m FROM kept),
walk AS (
  SELECT 0::BIGINT AS step, range(1, n + 1) AS lab FROM size
  UNION ALL
  SELECT step + 1, list_transform(lab, lambda x: CASE WHEN x = greatest(lab[a], lab[b])
                                              THEN least(lab[a], lab[b]) ELSE x END)
  FROM walk JOIN kept ON ord = step + 1),
labels AS (SELECT p.vec_id AS id, dense_rank() OVER (ORDER BY lab[p.idx]) - 1 AS label
           FROM walk JOIN total ON step = m, pts p)"""
CUT_COUNT = CUT.replace("{cut}", "ord <= (SELECT n - 10 FROM size)")
CUT_HEIGHT = CUT.replace("{cut}", "h < 1.15")

# Greedy merging: each step finds the smallest distance and rewrites two rows and columns
GREEDY = """
pts AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                            row_number() OVER (ORDER BY vec_id) AS idx FROM embeddings),
dist AS MATERIALIZED (SELECT x.idx, list(CASE WHEN x.idx = y.idx THEN 'inf'::DOUBLE
                                         ELSE list_distance(x.e, y.e) END ORDER BY y.idx) AS ds
                      FROM pts x, pts y GROUP BY x.idx),
merging AS (
  SELECT 0::BIGINT AS step, list(ds ORDER BY idx) AS m, list(1.0::DOUBLE) AS n,
         0::BIGINT AS a, 0::BIGINT AS b, 0::DOUBLE AS h FROM dist
  UNION ALL
  SELECT step + 1,
         list_transform(range(1, len(m) + 1), lambda x:
           CASE WHEN x = j THEN list_transform(row, lambda y: 'inf'::DOUBLE)
                WHEN x = i THEN row
                ELSE m[x][1:i - 1] || [row[x]] || m[x][i + 1:j - 1] || ['inf'::DOUBLE] || m[x][j + 1:] END),
         list_transform(range(1, len(m) + 1), lambda x: CASE WHEN x = i THEN n[i] + n[j] ELSE n[x] END),
         i, j, h
  FROM (SELECT step, m, n, i, j, h, list_transform(range(1, len(m) + 1), lambda k: {rule}) AS row
    FROM (SELECT step, m, n, i, list_position(m[i], lows[i]) AS j, lows[i] AS h
      FROM (SELECT step, m, n, lows, list_position(lows, list_min(lows)) AS i
        FROM (SELECT step, m, n, list_transform(m, lambda r: list_min(r)) AS lows
              FROM merging WHERE step < len(m) - 1)))))"""
MERGES = """SELECT x.vec_id AS a, y.vec_id AS b, round(h, 6) AS height, CAST(n[a] AS BIGINT) AS size
FROM merging JOIN pts x ON x.idx = a JOIN pts y ON y.idx = b WHERE step > 0"""
RULES = {
    "complete": "greatest(m[i][k], m[j][k])",
    "average": "(n[i] * m[i][k] + n[j] * m[j][k]) / (n[i] + n[j])",
    "ward": """sqrt(((n[i] + n[k]) * m[i][k] ** 2 + (n[j] + n[k]) * m[j][k] ** 2 - n[k] * h ** 2)
                     / (n[i] + n[j] + n[k]))""",
}

ORACLE = {
    "corpus_scan": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, text FROM documents",
    "conversation_scan": """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, text
FROM conversations""",
    "corpus_in_file_order": "SELECT row_number() OVER () - 1 AS pos, text, lang FROM documents",
    "strip_mail": STRIP_MAIL,
    "tokens": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, toks[i] AS token FROM (
  SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{PATTERN}') AS toks FROM documents))""",
    "tokens_nostop": f"""SELECT * FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, toks[i] AS token FROM (
  SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{PATTERN}') AS toks FROM documents)))
WHERE token NOT IN ({STOP})""",
    "doc_term_counts": build(TOK, DTC, select="SELECT doc_id, term, cnt FROM dtc", stop=True),
    "vocabulary": build(TOK, DTC, VOCAB, select="SELECT term_id, term, tf FROM vocab", stop=True),
    "dtm": build(*BASE, select="SELECT slice_id, doc_id, term_id, cnt FROM dtm", stop=True),
    "presence": build(*BASE, select="SELECT slice_id, doc_id, term_id FROM dtm", stop=True),
    "dtm_transform": build(
        TOK, DTC, VOCAB,
        f"""
fresh AS (SELECT item_id AS doc_id, text FROM benchmark
          UNION ALL SELECT conv_id * 100000 + turn + 1000000000, text FROM conversations),
ftok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM fresh)""",
        select="""SELECT doc_id, term_id, count(*) AS cnt FROM ftok JOIN vocab USING (term)
GROUP BY doc_id, term_id""",
        stop=True,
    ),
    "dtm_large_vocabulary": build(
        TOK, DTC, VOCAB.replace("LIMIT 500", "LIMIT 100000"),
        select="SELECT doc_id, term_id, cnt FROM dtc JOIN vocab USING (term)", stop=True,
    ),
    "slice_by_position": build(SLICED, select="SELECT doc_id, slice_id FROM sliced"),
    "slice_sizes": """SELECT slice_id, count(*) AS n_docs FROM (
  SELECT CAST(least(pos // (n // 7), 6) AS INTEGER) AS slice_id FROM (
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents))
GROUP BY slice_id""",
    "time_sliced_corpus": build(
        EVENT_TOKENS, VOCAB,
        # seven-day windows counted from the epoch
        """
esl AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY epoch_us(ts) // 604800000000) - 1 AS INTEGER)
               AS slice_id FROM ev)""",
        select="""SELECT slice_id, term_id, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_docs
FROM dtc JOIN vocab USING (term) JOIN esl USING (doc_id) GROUP BY slice_id, term_id""",
    ),
    "topic_word": build(
        *TOPICS,
        select="""SELECT slice_id, topic_id, term_id,
  round((coalesce(lam, 0) + 0.25) / sum(coalesce(lam, 0) + 0.25) OVER (PARTITION BY slice_id, topic_id), 6) AS p
FROM (SELECT DISTINCT slice_id, topic_id FROM counts) CROSS JOIN (SELECT term_id FROM vocab)
LEFT JOIN counts USING (slice_id, topic_id, term_id)""",
    ),
    "doc_freq": build(*BASE, select="""SELECT slice_id, term_id, count(*) AS n_docs FROM dtm
GROUP BY slice_id, term_id"""),
    "top_words": build(*TOPICS, TOP, select="SELECT slice_id, topic_id, rank, term_id, round(p, 6) AS p FROM top"),
    "top_words_ties": build(
        *BASE,
        """
named AS (SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS topic_id
          FROM (SELECT DISTINCT source FROM documents)),
counts AS (SELECT slice_id, topic_id, term_id, CAST(sum(cnt) AS DOUBLE) AS lam
           FROM dtm JOIN named USING (source) GROUP BY slice_id, topic_id, term_id),
tw AS (SELECT slice_id, topic_id, term_id,
              lam / sum(lam) OVER (PARTITION BY slice_id, topic_id) AS p FROM counts)""",
        TOP,
        select="SELECT slice_id, topic_id, rank, term_id, round(p, 6) AS p FROM top",
    ),
    "topic_word_pairs": build(*TOPICS, TOP, NPMI, select="SELECT slice_id, topic_id, term_i, term_j FROM pairs"),
    "cooccurrence": build(
        *TOPICS, TOP, NPMI,
        select="""SELECT slice_id, topic_id, term_i, term_j, n_docs
FROM pairs JOIN co USING (slice_id, term_i, term_j)""",
    ),
    "npmi": build(*TOPICS, TOP, NPMI, select="""SELECT slice_id, topic_id, term_i, term_j,
  round(npmi, 6) AS npmi FROM npmi"""),
    "topic_coherence": build(*TOPICS, TOP, NPMI, COHERENCE, select="""SELECT slice_id,
  round(coherence, 6) AS coherence FROM coherence"""),
    "topic_diversity": build(*TOPICS, TOP, select="""SELECT slice_id,
  round(count(DISTINCT term_id) / 40.0, 6) AS diversity FROM top GROUP BY slice_id"""),
    "topic_cosine": build(*TOPICS, COSINE, select="""SELECT slice_id, src_topic, tgt_topic,
  round(similarity, 6) AS similarity FROM cosine"""),
    "topic_cost": build(*TOPICS, COSINE, select="""SELECT slice_id, src_topic, tgt_topic,
  round(cost, 6) AS cost FROM cost"""),
    "topic_assignment": build(*TOPICS, COSINE, MATCH, select="SELECT slice_id, src_topic, tgt_topic FROM matching"),
    "topic_tracks": build(
        *TRACKED,
        select="""SELECT slice_id, track_id, topic_id,
  string_agg(topic_id, ' ' ORDER BY track_id) OVER (PARTITION BY slice_id ORDER BY track_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS assignment FROM tracks""",
    ),
    "aligned_topic_word": build(*TRACKED, select="""SELECT slice_id, track_id, term_id, round(p, 6) AS p
FROM aligned"""),
    "topic_drift": build(*TRACKED, DRIFT, select="""SELECT slice_id, track_id,
  round(js_distance, 6) AS js_distance FROM drift"""),
    "evolution_smoothness": build(*TRACKED, DRIFT, select="""SELECT
  round(1 - avg(js_distance), 6) AS evolution_smoothness FROM drift"""),
    "topic_alignment": build(*TOPICS, COSINE, ALIGNMENT, select="""SELECT slice_id,
  round(alignment, 6) AS alignment FROM alignment"""),
    "metric_averages": SUMMARY,
    "metrics_csv": SUMMARY,
    "ot_kernel": build(*TOPICS, COSINE, WEIGHTED, select="""SELECT problem, i, j, round(c, 6) AS c,
  round(k, 6) AS k FROM kernel"""),
    "sinkhorn_plan": build(*TOPICS, COSINE, WEIGHTED, select="""SELECT problem, i, j, round(c, 6) AS c,
  round(gamma, 6) AS gamma FROM plan"""),
    "ot_distance": build(*TOPICS, COSINE, WEIGHTED, select="""SELECT problem,
  round(sum(gamma * c), 6) AS distance FROM plan GROUP BY problem"""),
    "topic_ot_alignment": build(*TOPICS, COSINE, UNIFORM, select="""SELECT problem, i, j, round(gamma, 6) AS gamma
FROM (SELECT *, row_number() OVER (PARTITION BY problem, i ORDER BY gamma DESC, j) AS r FROM plan) WHERE r = 1"""),
    "nearest_neighbours": """SELECT id, arg_min(other, (d, other)) AS neighbour, round(min(d), 6) AS distance
FROM (SELECT x.vec_id AS id, y.vec_id AS other,
             list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d
      FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) GROUP BY id""",
    "hclust_single": build(TREE, select="""SELECT x.vec_id AS a, y.vec_id AS b, round(h, 6) AS height
FROM tree JOIN pts x ON x.idx = a JOIN pts y ON y.idx = b"""),
    "cut_n_clusters": build(TREE, CUT_COUNT, select="SELECT id, label FROM labels"),
    "cut_threshold": build(TREE, CUT_HEIGHT, select="SELECT id, label FROM labels"),
    "cluster_sizes": build(TREE, CUT_HEIGHT, select="SELECT label, count(*) AS n FROM labels GROUP BY label"),
}
ORACLE |= {
    f"hclust_{name}": build(GREEDY.replace("{rule}", rule), select=MERGES) for name, rule in RULES.items()
}
WARD_TREE = """
size AS (SELECT count(*) AS n FROM pts),
tree AS (SELECT a, b, h, step AS ord FROM merging WHERE step > 0)"""
ORACLE["ward_labels"] = build(
    GREEDY.replace("{rule}", RULES["ward"]), WARD_TREE, CUT_COUNT, select="SELECT id, label FROM labels"
)
# the same over all points, of which many are equal; the query merges their summaries
ORACLE["ward_summaries"] = build(
    GREEDY.replace("{rule}", RULES["ward"]).replace(
        "FROM embeddings)", "FROM (SELECT x.vec_id, y.embedding FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id % 60))"
    ),
    WARD_TREE, CUT_COUNT, select="SELECT id, label FROM labels",
)


# --- the topic model from a given start -----------------------------------------
# Four topics; the model is the stand-in's counts plus the prior.  Documents start from ones.


def digamma(x: str) -> str:
    """Shifted by eight, then the asymptotic series; exact to about 1e-13."""
    y = f"({x} + 8)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - 1 / (132 * {y} ** 10)"
    return f"({series} - " + " - ".join(f"1 / ({x} + {i})" for i in range(8)) + ")"


def log_mean(g: str) -> str:
    """E[log] of a Dirichlet list."""
    return f"list_transform({g}, lambda e: {digamma('e')} - {digamma(f'list_sum({g})')})"


GIVEN = """
lam0 AS MATERIALIZED (
  SELECT s.slice_id, v.term_id, list_transform(range(0, 4), lambda t: coalesce(m[t::INTEGER], 0) + 0.25) AS lam
  FROM (SELECT DISTINCT slice_id FROM sliced) s CROSS JOIN vocab v
  LEFT JOIN (SELECT slice_id, term_id, map(list(topic_id), list(lam)) AS m FROM counts GROUP BY ALL) c
    ON c.slice_id = s.slice_id AND c.term_id = v.term_id)"""

# the rows of exp(E[log beta]) of each document's terms, then the inner loop; {t} numbers the pass
E_STEP = """
total{t} AS (SELECT slice_id, [sum(lam[1]), sum(lam[2]), sum(lam[3]), sum(lam[4])] AS s FROM lam{t} GROUP BY slice_id),
elog{t} AS MATERIALIZED (
  SELECT slice_id, term_id, lam, list_transform(lam, lambda e, k: {psi_e} - {psi_s}) AS elog
  FROM lam{t} JOIN total{t} USING (slice_id)),
entry{t} AS MATERIALIZED (
  SELECT d.slice_id, d.doc_id, d.term_id, d.cnt::DOUBLE AS n, e.elog, list_transform(e.elog, lambda x: exp(x)) AS beta
  FROM dtm d JOIN elog{t} e ON e.slice_id = d.slice_id AND e.term_id = d.term_id),
rows{t} AS MATERIALIZED (
  SELECT doc_id, list(n ORDER BY term_id) AS n, list(beta ORDER BY term_id) AS beta,
         [list(beta[1] ORDER BY term_id), list(beta[2] ORDER BY term_id), list(beta[3] ORDER BY term_id), list(beta[4] ORDER BY term_id)] AS cols
  FROM entry{t} GROUP BY doc_id),
loop{t} AS (
  SELECT doc_id, 0 AS it, [1.0::DOUBLE, 1, 1, 1] AS g, 1.0::DOUBLE AS moved FROM rows{t}
  UNION ALL
  SELECT doc_id, it + 1, g2, (abs(g2[1] - g[1]) + abs(g2[2] - g[2]) + abs(g2[3] - g[3]) + abs(g2[4] - g[4])) / 4
  FROM (SELECT doc_id, it, g, list_transform(cols, lambda c, k: 0.25 + theta[k] * list_dot_product(c, r)) AS g2
    FROM (SELECT doc_id, it, g, cols, theta,
                 list_transform(beta, lambda b, i: n[i] / (list_dot_product(b, theta) + 2.220446049250313e-16)) AS r
      FROM (SELECT l.doc_id, it, g, n, beta, cols, list_transform({mean_g}, lambda x: exp(x)) AS theta
            FROM loop{t} l JOIN rows{t} x ON x.doc_id = l.doc_id WHERE it < 100 AND moved >= 1e-3)))),
gamma{t} AS MATERIALIZED (SELECT doc_id, arg_max(g, it) AS g FROM loop{t} GROUP BY doc_id)"""

# expected counts, and the model of the next pass
M_STEP = """
stats{t} AS (
  SELECT slice_id, term_id, sum(w * theta[1]) AS s1, sum(w * theta[2]) AS s2, sum(w * theta[3]) AS s3, sum(w * theta[4]) AS s4
  FROM (SELECT slice_id, term_id, theta, n / (list_dot_product(beta, theta) + 2.220446049250313e-16) AS w
    FROM (SELECT e.slice_id, e.term_id, n, beta, list_transform({mean_g}, lambda x: exp(x)) AS theta
          FROM entry{t} e JOIN gamma{t} USING (doc_id)))
  GROUP BY slice_id, term_id),
lam{u} AS MATERIALIZED (
  SELECT e.slice_id, e.term_id, list_transform(e.elog, lambda x, k: 0.25 + exp(x) * coalesce([s1, s2, s3, s4][k], 0)) AS lam
  FROM elog{t} e LEFT JOIN stats{t} s ON s.slice_id = e.slice_id AND s.term_id = e.term_id)"""


def model_pass(text: str, t: int) -> str:
    parts = {"{t}": str(t), "{u}": str(t + 1), "{psi_e}": digamma("e"), "{psi_s}": digamma("s[k]"), "{mean_g}": log_mean("g")}
    for name, value in parts.items():
        text = text.replace(name, value)
    return text


ORACLE |= {
    "lda_fit_given": build(
        *TOPICS, GIVEN, model_pass(E_STEP, 0), model_pass(M_STEP, 0), model_pass(E_STEP, 1), model_pass(M_STEP, 1),
        select="""SELECT slice_id, topic_id, term_id, round(lam, 6) AS lam FROM (
  SELECT slice_id, term_id, unnest(range(0, 4))::INTEGER AS topic_id, unnest(lam) AS lam FROM lam2)""",
    ),
    # documents without a known term have equal shares
    "doc_topic_given": build(
        *TOPICS, GIVEN, model_pass(E_STEP, 0),
        select="""SELECT slice_id, doc_id, unnest(range(0, 4))::INTEGER AS topic_id, round(unnest(p), 6) AS p FROM (
  SELECT s.slice_id, s.doc_id, coalesce(list_transform(g, lambda x: x / list_sum(g)), [0.25, 0.25, 0.25, 0.25]) AS p
  FROM sliced s LEFT JOIN gamma0 USING (doc_id))""",
    ),
    "perplexity_given": build(
        *TOPICS, GIVEN, model_pass(E_STEP, 0),
        f"""
mean AS (SELECT s.slice_id, s.doc_id, coalesce(g, [0.25, 0.25, 0.25, 0.25]) AS g FROM sliced s LEFT JOIN gamma0 USING (doc_id)),
known AS MATERIALIZED (SELECT *, {log_mean("g")} AS m FROM mean),
words AS (
  SELECT e.slice_id, sum(n) AS n, sum(n * ln(list_sum(list_transform(elog, lambda x, k: exp(x + m[k]))))) AS b
  FROM entry0 e JOIN known USING (doc_id) GROUP BY e.slice_id),
docs AS (
  SELECT slice_id, sum(list_sum(list_transform(g, lambda x, k: (0.25 - x) * m[k] + lgamma(x) - lgamma(0.25)))
                       + lgamma(1.0) - lgamma(list_sum(g))) AS b FROM known GROUP BY slice_id),
cells AS (
  SELECT slice_id, sum(list_sum(list_transform(lam, lambda x, k: (0.25 - x) * elog[k] + lgamma(x) - lgamma(0.25)))) AS b
  FROM elog0 GROUP BY slice_id),
ends AS (
  SELECT slice_id, list_sum(list_transform(s, lambda x: lgamma(0.25 * v) - lgamma(x))) AS b
  FROM total0, (SELECT count(*) AS v FROM vocab))""",
        select="""SELECT slice_id, round(exp(-(words.b + docs.b + cells.b + ends.b) / n), 6) AS perplexity
FROM words JOIN docs USING (slice_id) JOIN cells USING (slice_id) JOIN ends USING (slice_id)""",
    ),
}

# transport between the even and the odd vectors of each label, over lists of any length
ORACLE["embedding_transport"] = """
WITH RECURSIVE vec AS (SELECT vec_id, label AS problem, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
kernel AS MATERIALIZED (
  SELECT problem, i, j, c, exp(-c / 0.5) + 1e-16 AS k,
         dense_rank() OVER (PARTITION BY problem ORDER BY i) AS x, dense_rank() OVER (PARTITION BY problem ORDER BY j) AS y
  FROM (SELECT a.problem, a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS c
        FROM vec a JOIN vec b ON a.problem = b.problem WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)),
by_row AS (SELECT problem, list(r ORDER BY i) AS m
           FROM (SELECT problem, i, list(k ORDER BY j) AS r FROM kernel GROUP BY problem, i) GROUP BY problem),
by_col AS (SELECT problem, list(r ORDER BY j) AS m
           FROM (SELECT problem, j, list(k ORDER BY i) AS r FROM kernel GROUP BY problem, j) GROUP BY problem),
prob AS MATERIALIZED (SELECT r.problem, r.m AS rows, c.m AS cols FROM by_row r JOIN by_col c USING (problem)),
sink AS (
  SELECT problem, 0 AS it, list_transform(rows, lambda r: 1.0::DOUBLE) AS u, list_transform(cols, lambda r: 1.0::DOUBLE) AS v,
         'inf'::DOUBLE AS moved FROM prob
  UNION ALL
  SELECT problem, it + 1, u2, list_transform(cols, lambda c: 1.0 / len(cols) / list_dot_product(c, u2)), list_distance(u, u2)
  FROM (SELECT s.problem, it, cols, u, list_transform(rows, lambda r: 1.0 / len(rows) / list_dot_product(r, v)) AS u2
        FROM sink s JOIN prob p ON p.problem = s.problem WHERE it < 200 AND NOT moved < 1e-9))
SELECT k.problem, k.i, k.j, round(k.c, 6) AS c, round(s.u[k.x] * s.v[k.y] * k.k, 9) AS gamma
FROM kernel k JOIN (SELECT problem, arg_max(u, it) AS u, arg_max(v, it) AS v FROM sink GROUP BY problem) s ON s.problem = k.problem"""
