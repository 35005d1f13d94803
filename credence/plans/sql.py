"""DuckDB oracle building blocks: the same relations as the Spark operators,
written as SQL common table expressions over the pre-registered tables."""

from __future__ import annotations

from credence.functions.text import effective_stop_words
from credence.sources.tables import CORPUS_SQL

STOPS = ", ".join(f"'{w}'" for w in effective_stop_words())
EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def words_sql(expr: str) -> str:
    """Cleaned word list of a text expression."""
    return (f"list_filter(regexp_extract_all(lower({expr}), '[a-z]+'), "
            f"lambda w: length(w) >= 3 AND NOT (w IN ({STOPS})))")


def weighted_sql(title: str = "title", text: str = "text") -> str:
    t = f"coalesce({title}, 'nan')"
    return f"({t} || ' ' || {t} || ' ' || coalesce({text}, 'nan'))"


def ngrams_sql(w: str = "w") -> str:
    return (f"list_concat({w}, list_transform(range(1, len({w})), "
            f"lambda i: {w}[i] || ' ' || {w}[i + 1]))")


def detector_ctes(source: str = "corpus", fit_filter: str = "TRUE",
                  max_features: int = 2000, min_df: int = 2) -> str:
    """CTEs corpus, words, terms, tf, ndocs, dfreq, vocab, weights over ``source``.

    ``fit_filter`` restricts the rows the vocabulary is fitted on.
    """
    return f"""
corpus AS ({CORPUS_SQL}),
words AS (SELECT doc_id, is_fake, lang, {words_sql(weighted_sql())} AS w FROM {source}),
terms AS (SELECT doc_id, is_fake, lang, {ngrams_sql()} AS terms FROM words),
tf AS (SELECT doc_id, is_fake, lang, term, count(*) AS tf
       FROM (SELECT doc_id, is_fake, lang, unnest(terms) AS term FROM terms)
       GROUP BY doc_id, is_fake, lang, term),
fit_tf AS (SELECT * FROM tf WHERE {fit_filter}),
ndocs AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE {fit_filter}),
dfreq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM fit_tf
          GROUP BY term HAVING count(*) >= {min_df}),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, df, n,
                 ln((1 + (SELECT n FROM ndocs)) / (1 + df)) + 1 AS idf
          FROM (SELECT * FROM dfreq ORDER BY n DESC, term LIMIT {max_features})),
xw AS (SELECT tf.doc_id, tf.is_fake, tf.lang, v.term_id, tf.tf * v.idf AS x
       FROM tf JOIN vocab v ON tf.term = v.term),
weights AS (SELECT doc_id, is_fake, lang, term_id,
                   x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM xw)"""


def moment_ctes() -> str:
    """CTEs after ``detector_ctes``: moments and scaled."""
    return f"""
means AS (SELECT term_id, sum(weight) / (SELECT n FROM ndocs) AS mean, count(*) AS m
          FROM weights GROUP BY term_id),
msum AS (SELECT w.term_id, any_value(s.mean) AS mean,
                (sum(pow(w.weight - s.mean, 2)) + ((SELECT n FROM ndocs) - any_value(s.m)) * pow(any_value(s.mean), 2))
                / (SELECT n FROM ndocs) AS var
         FROM weights w JOIN means s ON w.term_id = s.term_id GROUP BY w.term_id),
moments AS (SELECT term_id, mean, sqrt(var) AS std,
                   CASE WHEN var <= (SELECT n FROM ndocs) * {EPS} * var
                                    + pow((SELECT n FROM ndocs) * mean * {EPS}, 2)
                        THEN 1.0::DOUBLE ELSE sqrt(var) END AS scale
            FROM msum),
scaled AS (SELECT w.doc_id, w.is_fake, w.term_id, w.weight / m.scale AS v
           FROM weights w JOIN moments m ON w.term_id = m.term_id)"""


def distance_ctes(centroids: str, clusters: str, name: str) -> str:
    """CTEs ``{name}_d2`` (doc_id, is_fake, cluster, d2) to the centroids of a CTE, and ``{name}`` (the nearest, with distance).

    ``clusters``: SQL list of the cluster numbers; one without centroid rows is the zero vector.
    """
    return f"""
{name}_pairs AS (SELECT doc_id, is_fake, CAST(unnest({clusters}) AS INTEGER) AS cluster FROM corpus),
{name}_cc AS (SELECT cluster, sum(value * value) AS cc FROM {centroids} GROUP BY cluster),
{name}_dots AS (SELECT s.doc_id, c.cluster, sum(s.v * c.value) AS dot
                FROM scaled s JOIN {centroids} c ON s.term_id = c.term_id GROUP BY s.doc_id, c.cluster),
{name}_raw AS (SELECT a.doc_id, a.is_fake, a.cluster,
                      coalesce(vv.vv, 0) - 2 * coalesce(d.dot, 0) + coalesce(k.cc, 0) AS raw, coalesce(vv.vv, 0) + coalesce(k.cc, 0) AS mag
               FROM {name}_pairs a LEFT JOIN {name}_cc k ON a.cluster = k.cluster LEFT JOIN vv ON vv.doc_id = a.doc_id
               LEFT JOIN {name}_dots d ON d.doc_id = a.doc_id AND d.cluster = a.cluster),
{name}_d2 AS MATERIALIZED (SELECT doc_id, is_fake, cluster, CASE WHEN raw <= 1e-9 * mag THEN 0.0::DOUBLE ELSE raw END AS d2 FROM {name}_raw),
{name} AS MATERIALIZED (SELECT doc_id, is_fake, cluster, sqrt(d2) AS distance
             FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, cluster) AS rk FROM {name}_d2)
             WHERE rk = 1)"""


def class_mean_ctes() -> str:
    """CTEs after ``moment_ctes``: centroids of the two classes, assigned."""
    return f"""
sizes AS (SELECT CAST(is_fake AS INTEGER) AS cluster, count(*) AS size FROM corpus GROUP BY 1),
centroids AS (SELECT c.cluster, s.term_id, sum(s.v) / any_value(c.size) AS value
              FROM scaled s JOIN sizes c ON CAST(s.is_fake AS INTEGER) = c.cluster
              GROUP BY c.cluster, s.term_id),
vv AS (SELECT doc_id, sum(v * v) AS vv FROM scaled GROUP BY doc_id),
{distance_ctes("centroids", "[0, 1]", "assigned").strip()}"""


def _seed_ctes(seed: int) -> list[str]:
    """CTEs after ``moment_ctes``: vv, kk, and the seeds of k-means++ by hashed chances as cent0."""
    parts = ["""
vv AS MATERIALIZED (SELECT doc_id, sum(v * v) AS vv FROM scaled GROUP BY doc_id),
kk AS (SELECT CAST(least(8, greatest(3, count(*) // 1000)) AS INTEGER) AS k FROM corpus)""", f"""
seed1 AS MATERIALIZED (SELECT 0 AS cluster, doc_id FROM corpus ORDER BY md5('{seed}:' || doc_id) LIMIT 1)"""]
    for j in range(1, 8):
        parts.append(f"""
points{j} AS MATERIALIZED (SELECT s.cluster, x.term_id, x.v AS value FROM seed{j} s JOIN scaled x ON x.doc_id = s.doc_id)""")
        parts.append(distance_ctes(f"points{j}", f"range(0, {j})", f"near{j}"))
        parts.append(f"""
seed{j + 1} AS MATERIALIZED (
  SELECT cluster, doc_id FROM seed{j}
  UNION ALL
  SELECT * FROM (SELECT {j} AS cluster, doc_id FROM near{j} WHERE distance > 0 AND (SELECT k FROM kk) > {j}
   ORDER BY -ln((CAST(('0x' || substr(md5('{seed}:{j}:' || doc_id), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / (distance * distance) LIMIT 1))""")
    parts.append("""
cent0 AS MATERIALIZED (SELECT s.cluster, x.term_id, x.v AS value FROM seed8 s JOIN scaled x ON x.doc_id = s.doc_id)""")
    return parts


def kmeans_ctes(rounds: int, seed: int = 42) -> str:
    """CTEs after ``moment_ctes``: k-means++ by hashed chances, ``rounds`` Lloyd rounds, assigned."""
    parts = _seed_ctes(seed)
    for r in range(rounds):
        parts.append(distance_ctes(f"cent{r}", "range(0, (SELECT k FROM kk))", f"round{r}"))
        parts.append(f"""
sizes{r} AS (SELECT cluster, count(*) AS n FROM round{r} GROUP BY cluster),
cent{r + 1} AS MATERIALIZED (
  SELECT a.cluster, x.term_id, sum(x.v) / any_value(n.n) AS value
  FROM round{r} a JOIN scaled x ON x.doc_id = a.doc_id JOIN sizes{r} n ON n.cluster = a.cluster GROUP BY a.cluster, x.term_id
  UNION ALL SELECT cluster, term_id, value FROM cent{r} WHERE cluster NOT IN (SELECT cluster FROM sizes{r}))""")
    parts.append(distance_ctes(f"cent{rounds}", "range(0, (SELECT k FROM kk))", "assigned"))
    return ",".join(parts)


def settled_kmeans_ctes(max_iter: int, tol: float, seed: int = 42) -> str:
    """CTEs after ``moment_ctes`` (WITH RECURSIVE): k-means++ by hashed chances, Lloyd rounds until the summed squared shift is at most ``tol`` or for ``max_iter`` rounds, assigned.

    ``lloyd`` has the centroids of every round and, as cluster -1, the round's shift.
    """
    parts = _seed_ctes(seed)
    parts.append(f"""
lloyd AS (
  SELECT 0 AS round, cluster, term_id, value FROM (SELECT cluster, term_id, value FROM cent0 UNION ALL SELECT -1, -1, 'inf'::DOUBLE)
  UNION ALL
  SELECT * FROM (
    WITH turn AS (SELECT round + 1 AS round FROM lloyd WHERE cluster < 0 AND value > {tol!r}::DOUBLE AND round < {max_iter}),
    held AS (SELECT cluster, term_id, value FROM lloyd WHERE cluster >= 0),{distance_ctes("held", "range(0, (SELECT k FROM kk))", "near")},
    sizes AS (SELECT cluster, count(*) AS n FROM near GROUP BY cluster),
    moved AS MATERIALIZED (
      SELECT a.cluster, x.term_id, sum(x.v) / any_value(n.n) AS value
      FROM near a JOIN scaled x ON x.doc_id = a.doc_id JOIN sizes n ON n.cluster = a.cluster GROUP BY a.cluster, x.term_id
      UNION ALL SELECT cluster, term_id, value FROM held WHERE cluster NOT IN (SELECT cluster FROM sizes)),
    shift AS (SELECT coalesce(sum(pow(coalesce(m.value, 0) - coalesce(h.value, 0), 2)), 0) AS shift
              FROM moved m FULL JOIN held h ON m.cluster = h.cluster AND m.term_id = h.term_id)
    SELECT round, cluster, term_id, value FROM turn, moved UNION ALL SELECT round, -1, -1, shift FROM turn, shift)),
cent AS MATERIALIZED (SELECT cluster, term_id, value FROM lloyd WHERE cluster >= 0 AND round = (SELECT max(round) FROM lloyd))""")
    parts.append(distance_ctes("cent", "range(0, (SELECT k FROM kk))", "assigned"))
    return ",".join(parts)


def score_ctes() -> str:
    """CTEs after ``assigned``: cluster statistics and scores."""
    return f"""
cstats AS (SELECT cluster, count(*) AS size, avg(distance) AS mean, stddev_pop(distance) AS std,
                  max(distance) AS max, avg(CAST(is_fake AS DOUBLE)) AS fake_ratio
           FROM assigned GROUP BY cluster),
zs AS (SELECT a.doc_id, a.is_fake, a.cluster, a.distance, s.fake_ratio AS cluster_fake_ratio,
              CASE WHEN s.std <> 0 THEN (a.distance - s.mean) / s.std
                   WHEN a.distance > s.mean THEN 'inf'::DOUBLE
                   WHEN a.distance < s.mean THEN '-inf'::DOUBLE
                   ELSE 'nan'::DOUBLE END AS z_score
       FROM assigned a JOIN cstats s ON a.cluster = s.cluster),
scores AS (SELECT *, (cluster_fake_ratio + 1.0 / (1.0 + exp(2.0 - z_score))) / 2.0 AS fake_score FROM zs)"""


def scoring_ctes() -> str:
    """CTEs after ``detector_ctes``: moments .. scores with class-mean centroids."""
    return ",".join(part.rstrip() for part in (moment_ctes(), class_mean_ctes(), score_ctes()))


def epoch_ctes(source: str, num_labels: int, epochs: int, steps: int, rate: float, buckets: int, seed: int = 42, batch: int = 8) -> str:
    """CTEs of a softmax training run over ``source`` (doc_id, text, label): every step of AdamW written out.

    Ends with ``history`` (one row an epoch) and ``scored`` (doc_id, label,
    epoch, prediction, p of each label as p0, p1 ..) of all rows of ``source``.
    The bias is bucket -1, which every row has once.
    """
    parts = [f"""
src AS MATERIALIZED ({source}),
part AS MATERIALIZED (SELECT doc_id, label, row_number() OVER (ORDER BY md5('{seed}:' || doc_id)) <= (SELECT CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT) FROM src) AS val,
         CAST(('0x' || substr(md5('{seed}:block:' || doc_id), 1, 8)) AS BIGINT) % {steps} AS block FROM src),
tfb AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {buckets} AS bucket, count(*) AS tf
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, 'nan')), '[\\pL\\pN_]{{2,}}')) AS term FROM src) GROUP BY ALL),
dfb AS (SELECT bucket, count(*) AS df FROM tfb JOIN part USING (doc_id) WHERE NOT val GROUP BY bucket),
xb AS (SELECT doc_id, bucket, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM part WHERE NOT val)) / (1.0 + coalesce(df, 0))) + 1.0) AS x FROM tfb LEFT JOIN dfb USING (bucket)),
feats AS MATERIALIZED (
  SELECT doc_id, label, val, block, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM xb JOIN part USING (doc_id)
  UNION ALL SELECT doc_id, label, val, block, -1, 1.0::DOUBLE FROM part),
w0 AS MATERIALIZED (SELECT bucket, label, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
       FROM (SELECT bucket, unnest(range(0, {num_labels})) AS label FROM (SELECT DISTINCT bucket FROM feats WHERE NOT val))),
steps0 AS (SELECT 0 AS epoch, 0.0::DOUBLE AS loss WHERE FALSE)"""]
    total = epochs * steps
    for t in range(1, total + 1):
        now = rate * (total - t + 1) / total
        parts.append(f"""
b{t} AS MATERIALIZED (SELECT * FROM feats WHERE NOT val AND block = {(t - 1) % steps}),
z{t} AS (SELECT b.doc_id, any_value(b.label) AS y, w.label, sum(b.x * w.w) AS z FROM b{t} b JOIN w{t - 1} w USING (bucket) GROUP BY b.doc_id, w.label),
p{t} AS MATERIALIZED (SELECT doc_id, y, label, z, max(z) OVER d + ln(sum(exp(z - top)) OVER d) AS lse, exp(z - top) / sum(exp(z - top)) OVER d AS p
       FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS top FROM z{t}) WINDOW d AS (PARTITION BY doc_id)),
g{t} AS MATERIALIZED (SELECT b.bucket, p.label, sum(b.x * (p.p - CASE WHEN p.y = p.label THEN 1 ELSE 0 END)) / (SELECT count(DISTINCT doc_id) FROM b{t}) AS g
       FROM b{t} b JOIN p{t} p USING (doc_id) GROUP BY b.bucket, p.label),
c{t} AS MATERIALIZED (SELECT least(1.0, 1.0 / (sqrt(coalesce(sum(g * g), 0)) + 1e-6)) AS c FROM g{t}),
w{t} AS MATERIALIZED (
  SELECT bucket, label, w * (1 - {now!r}::DOUBLE * 0.01) - {now!r}::DOUBLE * (m / (1 - pow(0.9::DOUBLE, {t}))) / (sqrt(v / (1 - pow(0.999::DOUBLE, {t}))) + 1e-8::DOUBLE) AS w, m, v
  FROM (SELECT w.bucket, w.label, w.w, w.m + 0.1::DOUBLE * (coalesce(g.g, 0) * c - w.m) AS m, w.v + 0.001::DOUBLE * (pow(coalesce(g.g, 0) * c, 2) - w.v) AS v
        FROM w{t - 1} w LEFT JOIN g{t} g ON g.bucket = w.bucket AND g.label = w.label, c{t})),
steps{t} AS MATERIALIZED (SELECT * FROM steps{t - 1} UNION ALL
       SELECT {(t - 1) // steps + 1}, l FROM (SELECT avg(lse - z) AS l FROM p{t} WHERE label = y) WHERE l IS NOT NULL)""")
    union = " UNION ALL ".join(f"SELECT {e} AS epoch, bucket, label, w FROM w{e * steps}" for e in range(1, epochs + 1))
    p_of = ", ".join(f"max(CASE WHEN label = {j} THEN p END) AS p{j}" for j in range(num_labels))
    parts.append(f"""
we AS ({union}),
every AS (SELECT CAST(unnest(range(1, {epochs + 1})) AS INTEGER) AS epoch, doc_id, label AS y, val FROM part),
labels_ AS (SELECT epoch, doc_id, y, val, CAST(unnest(range(0, {num_labels})) AS INTEGER) AS label FROM every),
ze AS (SELECT f.doc_id, we.epoch, we.label, sum(f.x * we.w) AS z FROM feats f JOIN we USING (bucket) GROUP BY ALL),
zall AS MATERIALIZED (SELECT l.epoch, l.doc_id, l.y, l.val, l.label, coalesce(ze.z, 0) AS z FROM labels_ l LEFT JOIN ze USING (epoch, doc_id, label)),
pall AS MATERIALIZED (SELECT epoch, doc_id, y, val, label, z, exp(z - top) / sum(exp(z - top)) OVER d AS p, top + ln(sum(exp(z - top)) OVER d) - z AS nll
         FROM (SELECT *, max(z) OVER (PARTITION BY epoch, doc_id) AS top FROM zall) WINDOW d AS (PARTITION BY epoch, doc_id)),
scored AS MATERIALIZED (SELECT epoch, doc_id, y, val, CAST(arg_min(label, struct_pack(a := -z, b := label)) AS INTEGER) AS prediction, max(p) AS top_p, {p_of},
                  max(CASE WHEN label = y THEN nll END) AS nll FROM pall GROUP BY epoch, doc_id, y, val),
counted AS (SELECT epoch, count(*) AS n, avg(CASE WHEN prediction = y THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count_if(prediction = 1 AND y = 1) AS tp,
                   count_if(prediction = 1 AND y <> 1) AS fp, count_if(prediction <> 1 AND y = 1) AS fn FROM scored WHERE val GROUP BY epoch),
batched AS (SELECT epoch, avg(l) AS log_loss FROM (SELECT epoch, b, avg(nll) AS l FROM
            (SELECT epoch, nll, (row_number() OVER (PARTITION BY epoch ORDER BY doc_id) - 1) // {batch} AS b FROM scored WHERE val) GROUP BY epoch, b) GROUP BY epoch),
history AS (SELECT epoch, n, accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
                   CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, log_loss, train_loss
            FROM counted JOIN batched USING (epoch) JOIN (SELECT epoch, avg(loss) AS train_loss FROM steps{total} GROUP BY epoch) USING (epoch)),
best AS (SELECT epoch FROM history ORDER BY accuracy DESC, epoch LIMIT 1)""")
    return ",".join(p.strip() for p in parts)


def unseen_ctes(centroids: str) -> str:
    """CTEs after ``score_ctes``: ``new_scores`` of every row of ``documents`` by the model fitted on the corpus."""
    return f"""
nterms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({ngrams_sql()}) AS term FROM
           (SELECT doc_id, {words_sql(weighted_sql("substring(text, 1, 100) || '...'"))} AS w FROM documents)) GROUP BY ALL),
nweights AS (SELECT doc_id, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight
             FROM (SELECT t.doc_id, v.term_id, t.tf * v.idf AS x FROM nterms t JOIN vocab v ON t.term = v.term)),
nscaled AS MATERIALIZED (SELECT w.doc_id, w.term_id, w.weight / m.scale AS v FROM nweights w JOIN moments m ON w.term_id = m.term_id),
nvv AS (SELECT doc_id, sum(v * v) AS vv FROM nscaled GROUP BY doc_id),
ncc AS (SELECT cluster, sum(value * value) AS cc FROM {centroids} GROUP BY cluster),
ndots AS (SELECT s.doc_id, c.cluster, sum(s.v * c.value) AS dot FROM nscaled s JOIN {centroids} c ON s.term_id = c.term_id GROUP BY ALL),
npairs AS (SELECT doc_id, CAST(unnest(range(0, (SELECT k FROM kk))) AS INTEGER) AS cluster FROM documents),
nd2 AS (SELECT p.doc_id, p.cluster, coalesce(vv, 0) - 2 * coalesce(dot, 0) + coalesce(cc, 0) AS raw, coalesce(vv, 0) + coalesce(cc, 0) AS mag
        FROM npairs p LEFT JOIN nvv ON nvv.doc_id = p.doc_id LEFT JOIN ncc ON ncc.cluster = p.cluster LEFT JOIN ndots d ON d.doc_id = p.doc_id AND d.cluster = p.cluster),
nnear AS (SELECT doc_id, cluster, sqrt(d2) AS distance FROM
          (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, cluster) AS rk FROM
           (SELECT doc_id, cluster, CASE WHEN raw <= 1e-9 * mag THEN 0.0::DOUBLE ELSE raw END AS d2 FROM nd2)) WHERE rk = 1),
nz AS (SELECT a.doc_id, a.cluster, s.fake_ratio AS cluster_fake_ratio,
              CASE WHEN s.std <> 0 THEN (a.distance - s.mean) / s.std WHEN a.distance > s.mean THEN 'inf'::DOUBLE WHEN a.distance < s.mean THEN '-inf'::DOUBLE
                   WHEN s.mean IS NOT NULL THEN 'nan'::DOUBLE END AS z_score
       FROM nnear a LEFT JOIN cstats s ON a.cluster = s.cluster),
new_scores AS (SELECT *, (cluster_fake_ratio + 1.0 / (1.0 + exp(2.0 - z_score))) / 2.0 AS fake_score FROM nz)"""
