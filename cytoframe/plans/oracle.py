"""The same results as plain SQL on the test tables, for an independent engine."""

from __future__ import annotations

ORACLE: dict[str, str] = {}
SEED = "55"
PERMUTATIONS = 1000
CONDITIONAL_PERMUTATIONS = 200
REPLICATE_COUNT = 10
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def six(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 5e-7 THEN 0.0 ELSE round({x}, 6) END)"


EXPR = """expr AS (
  SELECT p_brand || '/' || p_type AS gene, o_custkey AS cell_id, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2)"""
CELLS = """cells AS (
  SELECT c_custkey AS cell_id, c_nationkey AS cluster, c_mktsegment AS condition, r_name AS disease
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MAPPED = """mapped AS (
  SELECT o_orderkey AS cell_id, c_nationkey AS cluster, o_orderstatus AS label_l1, o_orderpriority AS label_l2,
         o_orderpriority || '/' || o_orderstatus AS label_l3,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 100) / 100.0 AS score_l1,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000.0 AS score_l2,
         (CAST(round(o_totalprice * 100) AS BIGINT) % 10000) / 10000.0 AS score_l3,
         round((c_acctbal + 1000) / 11000, 4) AS mapping_score, n_name AS sample, r_name AS grp
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
gated AS (
  SELECT *, CASE WHEN score_l1 > 0.70 AND mapping_score > 0.70 THEN label_l1 ELSE 'uncertain' END AS robust_l1,
         CASE WHEN score_l2 > 0.70 AND mapping_score > 0.70 THEN label_l2 ELSE 'uncertain' END AS robust_l2,
         CASE WHEN score_l3 > 0.70 AND mapping_score > 0.70 THEN label_l3 ELSE 'uncertain' END AS robust_l3
  FROM mapped)"""
VECTORS = """vectors AS (
  SELECT vec_id AS cell_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v, vec_id % 5 = 0 AS is_query,
         'A' || CAST(label % 2 AS VARCHAR) AS label_l1, 'B' || CAST(label % 5 AS VARCHAR) AS label_l2,
         'C' || CAST(label AS VARCHAR) AS label_l3,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings),
q AS (SELECT cell_id AS id, v FROM vectors WHERE is_query),
r AS (SELECT cell_id AS id, v FROM vectors WHERE NOT is_query)"""
SETS = """gene_sets AS (
  SELECT DISTINCT 'BRAND' AS collection, 'HALLMARK_' || p_brand AS set_name, p_brand || '/' || p_type AS gene FROM part
  UNION ALL
  SELECT DISTINCT 'TYPE', 'HALLMARK_' || p_type, p_brand || '/' || p_type FROM part)"""
RANKS = f"""{EXPR}, {CELLS}, {SETS},
ranks AS (
  SELECT 'ALL' AS dataset, gene, round(avg(value), 9) AS stat FROM expr GROUP BY gene
  UNION ALL
  SELECT condition, gene, round(avg(value), 9) FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY stat DESC, gene) AS rank,
         count(*) OVER (PARTITION BY dataset) AS universe
  FROM ranks),
sizes AS (
  SELECT dataset, collection, set_name, count(*) AS size FROM ordered JOIN gene_sets USING (gene)
  GROUP BY ALL HAVING count(*) BETWEEN 1 AND 500),
hits AS (SELECT * FROM ordered JOIN gene_sets USING (gene) JOIN sizes USING (dataset, collection, set_name))"""


def running(source: str, keys: str) -> str:
    """Running scores of every group of ``source``."""
    return f"""(
  SELECT *, CASE WHEN universe > size AND whole > 0 THEN (cum - abs(stat)) / whole - (rank - hit) / (universe - size) END AS before,
         CASE WHEN universe > size AND whole > 0 THEN cum / whole - (rank - hit) / (universe - size) END AS score
  FROM (SELECT *, sum(abs(stat)) OVER (PARTITION BY {keys}) AS whole,
               sum(abs(stat)) OVER (PARTITION BY {keys} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum,
               row_number() OVER (PARTITION BY {keys} ORDER BY rank) AS hit
        FROM {source}))"""


def adjusted(source: str, keys: str) -> str:
    """``source`` plus p_adj within ``keys``; NULL p values are not counted."""
    return f"""(
  SELECT s.* EXCLUDE (raw), CASE WHEN p_value IS NULL THEN NULL ELSE least(1.0,
         min(raw) OVER (PARTITION BY {keys} ORDER BY p_value DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS p_adj
  FROM (SELECT *, p_value * count(p_value) OVER (PARTITION BY {keys})
               / count(p_value) OVER (PARTITION BY {keys} ORDER BY p_value ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw
        FROM {source}) s)"""


def knn(queries: str, references: str, k: int, skip_same: bool = False) -> str:
    where = "WHERE a.id <> b.id" if skip_same else ""
    return f"""(
  SELECT * FROM (
    SELECT a.id AS query_id, b.id AS ref_id, list_distance(a.v, b.v) AS dist,
           CAST(row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS INTEGER) AS rank
    FROM {queries} a CROSS JOIN {references} b {where}) WHERE rank <= {k})"""


# ---- sources, filters, joins ----------------------------------------------------------------

ORACLE["tsv_round_trip"] = """SELECT c_custkey AS cell_id, nullif(c_mktsegment, 'BUILDING') AS condition, c_acctbal AS score
FROM customer"""
ORACLE["wide_matrix_to_long"] = f"WITH {EXPR} SELECT gene, cell_id, value FROM expr"
ORACLE["gene_set_catalog"] = f"""WITH {SETS} SELECT collection, count(DISTINCT set_name) AS sets,
  CAST(count(*) AS BIGINT) AS memberships FROM gene_sets GROUP BY collection"""
ORACLE["semi_join_cells"] = f"""WITH {EXPR}, {CELLS} SELECT * FROM cells
WHERE cell_id IN (SELECT cell_id FROM expr WHERE gene = 'Brand#2/LARGE' AND value > 0)"""
ORACLE["exclude_labels_keep_null"] = f"""WITH {MAPPED} SELECT nullif(label_l2, '5-LOW') AS label, sample, count(*) AS n
FROM mapped WHERE label_l2 NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2"""
ORACLE["prefix_cohorts"] = f"""WITH {MAPPED} SELECT CASE WHEN grp LIKE 'A%' THEN 'starts_a' ELSE 'starts_m' END AS cohort,
  grp, count(*) AS n FROM mapped WHERE grp LIKE 'A%' OR grp LIKE 'M%' GROUP BY 1, 2"""
ORACLE["select_cells"] = f"""WITH {EXPR}, {CELLS},
keep AS (SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM cells WHERE condition = 'BUILDING'))
SELECT 'counts' AS layer, gene, cell_id, {six('value')} AS value FROM keep
UNION ALL
SELECT 'data', gene, cell_id, {six('value / sum(value) OVER (PARTITION BY cell_id) * 1e6')} FROM keep"""
MEMBERS = f"""{EXPR}, {CELLS},
base AS (
  SELECT 'B' AS cohort, cell_id FROM cells WHERE cluster = 7 AND condition = 'BUILDING'
  UNION ALL SELECT 'T', cell_id FROM cells WHERE cluster = 3 AND condition = 'MACHINERY'
  UNION ALL SELECT 'CD20', cell_id FROM expr WHERE gene = 'Brand#2/LARGE' AND value > 0
  UNION ALL SELECT 'CD69', cell_id FROM expr WHERE gene = 'Brand#1/SMALL' AND value > 0),
members AS (
  SELECT * FROM base
  UNION ALL
  SELECT 'B_minus_CD20', cell_id FROM base WHERE cohort = 'B' AND cell_id NOT IN (SELECT cell_id FROM base WHERE cohort = 'CD20')
  UNION ALL
  SELECT 'T_and_CD69', cell_id FROM base WHERE cohort = 'T' AND cell_id IN (SELECT cell_id FROM base WHERE cohort = 'CD69')),
listed AS (SELECT unnest(['B', 'B_minus_CD20', 'CD20', 'T', 'T_and_CD69']) AS cohort)"""
ORACLE["deplete_cells"] = f"""WITH {MEMBERS} SELECT listed.cohort, gene, e.cell_id, value FROM listed CROSS JOIN expr e
WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.cohort = listed.cohort AND m.cell_id = e.cell_id)"""
ORACLE["layout_with_metadata"] = f"""WITH {VECTORS}
SELECT a.cell_id, {six('a.x')} AS x, {six('a.y')} AS y, b.label_l1, b.label_l2, b.label_l3
FROM vectors a LEFT JOIN (SELECT * FROM vectors WHERE NOT is_query) b USING (cell_id)"""
ORACLE["knn_exact"] = f"WITH {VECTORS} SELECT query_id, ref_id, {six('dist')} AS dist, rank FROM {knn('q', 'r', 20)}"
ORACLE["knn_partitioned"] = ORACLE["knn_exact"]
ORACLE["knn_l2_norm"] = f"""WITH {VECTORS},
qn AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM q),
rn AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) AS v FROM r)
SELECT query_id, ref_id, {six('dist')} AS dist, rank FROM {knn('qn', 'rn', 20)}"""
ORACLE["remap_neighbors"] = ORACLE["knn_exact"]

# ---- aggregations, shares, gates --------------------------------------------------------------

ORACLE["label_counts"] = f"WITH {MAPPED} SELECT robust_l2, label_l2, count(*) AS n FROM gated GROUP BY ALL"
ORACLE["certain_counts_by_group"] = f"""WITH {MAPPED} SELECT grp, count(*) AS n FROM gated
WHERE robust_l2 <> 'uncertain' GROUP BY grp"""
ORACLE["contingency_table"] = f"""WITH {MAPPED} SELECT sample, count(*) FILTER (label_l1 = 'F') AS "n_F",
  count(*) FILTER (label_l1 = 'O') AS "n_O", count(*) FILTER (label_l1 = 'P') AS "n_P" FROM mapped GROUP BY sample"""
ORACLE["layout_centroids"] = f"""WITH {VECTORS}
SELECT CASE WHEN is_query THEN NULL ELSE label_l2 END AS label_l2, {six('avg(x)')} AS x, {six('avg(y)')} AS y, count(*) AS n
FROM vectors GROUP BY 1"""
ORACLE["label_score_order"] = f"""WITH {MAPPED}, m AS (SELECT label_l3, median(score_l3) AS med FROM mapped GROUP BY 1)
SELECT label_l3, {six('med')} AS med, CAST(row_number() OVER (ORDER BY med DESC, label_l3) AS INTEGER) AS position FROM m"""
ORACLE["score_box_stats"] = f"""WITH {MAPPED}, b AS (
  SELECT label_l2, quantile_cont(score_l2, 0.25) AS q1, quantile_cont(score_l2, 0.5) AS med, quantile_cont(score_l2, 0.75) AS q3
  FROM mapped GROUP BY 1),
f AS (SELECT *, score_l2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM mapped JOIN b USING (label_l2))
SELECT label_l2, {six('q1')} AS q1, {six('med')} AS med, {six('q3')} AS q3,
  {six('min(score_l2) FILTER (inside)')} AS whisker_low, {six('max(score_l2) FILTER (inside)')} AS whisker_high,
  count(*) AS n, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY label_l2, q1, med, q3"""
ORACLE["score_density"] = f"""WITH {MAPPED},
c AS (SELECT label_l2, least(511, greatest(0, CAST(floor(score_l2 * 512) AS BIGINT))) AS slot, count(*) AS c FROM mapped GROUP BY 1, 2),
s AS (SELECT label_l2, count(*) AS n, 0.9 * stddev_samp(score_l2) * pow(count(*), -0.2) AS bw FROM mapped GROUP BY 1),
g AS (SELECT CAST(unnest(range(65)) AS INTEGER) AS grid_id)
SELECT label_l2, grid_id, {six('grid_id / 64.0')} AS at,
  {six('sum(c * exp(-0.5 * pow((grid_id / 64.0 - (slot + 0.5) / 512) / bw, 2))) / (n * bw * sqrt(2 * pi()))')} AS density
FROM c JOIN s USING (label_l2) CROSS JOIN g GROUP BY label_l2, grid_id, n, bw"""
ORACLE["gene_detection"] = f"""WITH {EXPR} SELECT gene, count(*) FILTER (value > 0) AS positive_cells, sum(value) AS total
FROM expr GROUP BY gene"""
ORACLE["matrix_dims"] = f"""WITH {EXPR}, {CELLS} SELECT condition, count(DISTINCT gene) AS genes,
  count(DISTINCT cell_id) AS cells FROM expr JOIN cells USING (cell_id) GROUP BY 1"""
ORACLE["detection_histogram"] = f"""WITH {EXPR},
d AS (SELECT gene, count(*) FILTER (value > 0) AS positive_cells FROM expr GROUP BY 1)
SELECT CAST(floor(log10(positive_cells) * 10 + 1e-9) AS BIGINT) AS bin, count(*) AS genes FROM d WHERE positive_cells > 0 GROUP BY 1"""


def share(first: str, second: str, where: str = "TRUE") -> str:
    return f"""WITH {MAPPED}, c AS (SELECT {first}, {second}, count(*) AS n FROM gated WHERE {where} GROUP BY 1, 2)
SELECT {first}, {second}, n, CAST(sum(n) OVER (PARTITION BY {first}) AS BIGINT) AS tot,
  {six(f'n / sum(n) OVER (PARTITION BY {first})')} AS prop FROM c"""


ORACLE["label_share_by_cluster"] = share("cluster", "label_l2")
ORACLE["cluster_share_by_label"] = share("label_l2", "cluster")
ORACLE["label_share_by_cluster_certain"] = share("cluster", "robust_l1", "robust_l1 <> 'uncertain'")
ORACLE["cluster_share_by_label_certain"] = share("robust_l1", "cluster", "robust_l1 <> 'uncertain'")
ORACLE["label_share_matrix"] = f"""WITH {MAPPED}, t AS (SELECT cluster, count(*) AS tot FROM mapped GROUP BY 1)
SELECT label_l1, {', '.join(f"{six(f'count(*) FILTER (cluster = {c}) / coalesce(max(tot) FILTER (cluster = {c}), 1)')} AS c{c}" for c in range(25))}
FROM mapped JOIN t USING (cluster) GROUP BY label_l1"""
ORACLE["robust_labels"] = f"WITH {MAPPED} SELECT cell_id, robust_l1, robust_l2, robust_l3 FROM gated"
ORACLE["certainty_split"] = f"""WITH {MAPPED} SELECT robust_l2 <> 'uncertain' AS certain, label_l2, count(*) AS n,
  {six('avg(score_l2)')} AS mean_score FROM gated GROUP BY 1, 2"""
ORACLE["marker_by_label"] = f"""WITH {EXPR}, {CELLS},
f AS (SELECT condition, coalesce(value, 0.0) AS value
      FROM cells LEFT JOIN (SELECT * FROM expr WHERE gene = 'Brand#2/LARGE') USING (cell_id))
SELECT condition, count(*) AS n, {six('avg(value)')} AS mean_value, {six('avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share,
  max(value) AS max_value, {six('quantile_cont(value, 0.25)')} AS q1, {six('quantile_cont(value, 0.5)')} AS med,
  {six('quantile_cont(value, 0.75)')} AS q3 FROM f GROUP BY 1"""

# ---- set operations, reshape, scalars ----------------------------------------------------------

ORACLE["stack_cohorts"] = f"""WITH {MAPPED}
SELECT CASE WHEN grp = 'ASIA' THEN 'asia' ELSE 'rest' END AS dataset, CASE WHEN grp = 'ASIA' THEN grp ELSE 'other' END AS pathology,
  sample, label_l2, count(*) AS n FROM mapped GROUP BY 1, 2, 3, 4"""
ORACLE["cohort_algebra"] = f"WITH {MEMBERS} SELECT cohort, cell_id FROM members WHERE cohort IN ('B_minus_CD20', 'T_and_CD69')"
ORACLE["unpivot_matrix"] = """WITH kinds AS (SELECT DISTINCT p_type FROM part), brands AS (SELECT DISTINCT p_brand FROM part),
m AS (SELECT p_brand, p_type, max(p_retailprice) AS value FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, value FROM brands CROSS JOIN kinds LEFT JOIN m USING (p_brand, p_type)"""
ORACLE["scalar_labels"] = f"""SELECT p_partkey, substr(p_brand || '_HALLMARK_' || p_type, 1, 35) AS short_label,
  substr(p_name, 1, 6) AS short_name, p_brand || '.' || p_type || '-' || CAST(p_size AS VARCHAR) AS dotted,
  {six('log2(p_retailprice)')} AS log2_price, {six('-ln(p_retailprice)')} AS neg_ln_price, {six('log10(p_retailprice)')} AS log10_price,
  p_name LIKE '%ring%' AS has_ring, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class FROM part"""

# ---- reference mapping ---------------------------------------------------------------------------

RESIDUALS = f"""{EXPR},
depth AS (SELECT cell_id, sum(value) AS depth FROM expr GROUP BY 1),
genes AS (SELECT gene, sum(value) AS total FROM expr GROUP BY 1),
every AS (SELECT sum(value) AS grand, count(DISTINCT cell_id) AS n FROM expr),
dense AS (
  SELECT g.gene, d.cell_id, coalesce(e.value, 0) AS x, g.total * d.depth / every.grand AS mu, sqrt(every.n) AS clip
  FROM genes g CROSS JOIN depth d CROSS JOIN every LEFT JOIN expr e ON e.gene = g.gene AND e.cell_id = d.cell_id),
res AS (SELECT gene, cell_id, greatest(-clip, least(clip, (x - mu) / sqrt(mu + mu * mu / 100))) AS residual FROM dense)"""
ORACLE["pearson_residuals"] = f"""WITH {RESIDUALS}
SELECT gene, cell_id, {six('residual - avg(residual) OVER (PARTITION BY gene)')} AS residual FROM res"""
ORACLE["variable_features"] = f"""WITH {RESIDUALS},
v AS (SELECT gene, var_samp(residual) AS variance FROM res GROUP BY 1 ORDER BY round(var_samp(residual), 9) DESC, gene LIMIT 40)
SELECT gene, {six('variance')} AS variance, NOT ends_with(gene, '/SMALL') AS in_reference FROM v"""
ORACLE["project_embedding"] = f"""WITH {RESIDUALS},
kinds AS (SELECT CAST(row_number() OVER (ORDER BY kind) - 1 AS INTEGER) AS dim, kind FROM (SELECT unnest({TYPES}) AS kind)),
p AS (SELECT cell_id, dim, sum(residual * 0.2) AS value FROM res JOIN kinds ON split_part(gene, '/', 2) = kind GROUP BY 1, 2)
SELECT cell_id, dim, {six('value - avg(value) OVER (PARTITION BY dim)')} AS value FROM p"""
ANCHORS = f"""{VECTORS},
forth AS (SELECT * FROM {knn('q', 'r', 2)}),
back AS (SELECT * FROM {knn('r', 'q', 2)}),
anchors AS (SELECT f.query_id, f.ref_id, f.dist FROM forth f JOIN back b ON f.query_id = b.ref_id AND f.ref_id = b.query_id)"""
SCORED = f"""{ANCHORS},
around_q AS (SELECT query_id AS id, 'q' || CAST(ref_id AS VARCHAR) AS nb FROM {knn('q', 'q', 10, True)}
             UNION ALL SELECT query_id, 'r' || CAST(ref_id AS VARCHAR) FROM {knn('q', 'r', 10)}),
around_r AS (SELECT query_id AS id, 'r' || CAST(ref_id AS VARCHAR) AS nb FROM {knn('r', 'r', 10, True)}
             UNION ALL SELECT query_id, 'q' || CAST(ref_id AS VARCHAR) FROM {knn('r', 'q', 10)}),
overlap AS (
  SELECT a.query_id, a.ref_id, count(b.nb) AS shared FROM anchors a
  LEFT JOIN around_q n ON n.id = a.query_id LEFT JOIN around_r b ON b.id = a.ref_id AND b.nb = n.nb GROUP BY 1, 2),
cuts AS (SELECT quantile_cont(shared, 0.01) AS low, quantile_cont(shared, 0.90) AS high FROM overlap),
scored AS (
  SELECT query_id, ref_id, shared, least(1.0, greatest(0.0, CASE WHEN high > low THEN (shared - low) / (high - low)
    WHEN shared >= high THEN 1.0 ELSE 0.0 END)) AS score FROM overlap CROSS JOIN cuts)"""
WEIGHTS = f"""{SCORED},
ends AS (SELECT id, v FROM q WHERE id IN (SELECT query_id FROM scored)),
near AS (SELECT query_id, ref_id AS anchor_id, dist, max(dist) OVER (PARTITION BY query_id) AS far FROM {knn('q', 'ends', 10)}),
raw AS (
  SELECT n.query_id, n.anchor_id, s.ref_id,
         1 - exp(-(CASE WHEN far > 0 THEN 1 - dist / far ELSE 1 END) * score / 4) AS w
  FROM near n JOIN scored s ON s.query_id = n.anchor_id),
weights AS (
  SELECT query_id, anchor_id, ref_id,
         CASE WHEN sum(w) OVER (PARTITION BY query_id) > 0 THEN w / sum(w) OVER (PARTITION BY query_id) ELSE 0.0 END AS w FROM raw)"""
MOVED = f"""{WEIGHTS},
qlong AS (SELECT id, unnest(range(64)) AS dim, unnest(v) AS value FROM q),
rlong AS (SELECT id, unnest(range(64)) AS dim, unnest(v) AS value FROM r),
moved AS (
  SELECT b.id, b.dim, b.value + coalesce(s.shift, 0) AS value FROM qlong b LEFT JOIN (
    SELECT w.query_id, rl.dim, sum(w.w * (rl.value - ql.value)) AS shift FROM weights w
    JOIN rlong rl ON rl.id = w.ref_id JOIN qlong ql ON ql.id = w.anchor_id AND ql.dim = rl.dim GROUP BY 1, 2) s
  ON s.query_id = b.id AND s.dim = b.dim)"""
ORACLE["mutual_nn_anchors"] = f"WITH {ANCHORS} SELECT query_id, ref_id, {six('dist')} AS dist FROM anchors"
ORACLE["anchor_scores"] = f"WITH {SCORED} SELECT query_id, ref_id, shared, {six('score')} AS score FROM scored"
ORACLE["transfer_weights"] = f"WITH {WEIGHTS} SELECT query_id, anchor_id, ref_id, {six('w')} AS w FROM weights"
ORACLE["transfer_labels"] = f"""WITH {WEIGHTS},
long AS (UNPIVOT (SELECT cell_id AS ref_id, label_l1 AS l1, label_l2 AS l2, label_l3 AS l3 FROM vectors WHERE NOT is_query)
         ON l1, l2, l3 INTO NAME level VALUE label),
votes AS (SELECT query_id, level, label, sum(w) AS score FROM weights JOIN long USING (ref_id) GROUP BY 1, 2, 3)
SELECT query_id, level, label, {six('score')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY round(score, 12) DESC, label) AS place FROM votes) WHERE place = 1"""
ORACLE["integrate_embeddings"] = f"""WITH {MOVED}
SELECT id AS query_id, CAST(dim AS INTEGER) AS dim, {six('value')} AS value FROM moved"""
ORACLE["project_layout"] = f"""WITH {VECTORS},
near AS (SELECT *, min(dist) OVER (PARTITION BY query_id) AS d1, avg(dist) OVER (PARTITION BY query_id) AS mean FROM {knn('q', 'r', 20)}),
w AS (SELECT query_id, ref_id, CASE WHEN mean - d1 > 1e-12 THEN exp(-(dist - d1) / (mean - d1)) ELSE 1.0 END AS w FROM near)
SELECT query_id, {six('sum(w * x) / sum(w)')} AS x, {six('sum(w * y) / sum(w)')} AS y FROM w JOIN vectors ON cell_id = ref_id GROUP BY 1"""
ORACLE["mapping_score"] = f"""WITH {MOVED},
m AS (SELECT id, list(value ORDER BY dim) AS v FROM moved GROUP BY id),
old AS (SELECT * FROM {knn('q', 'q', 15, True)}),
new AS (SELECT * FROM {knn('m', 'm', 15, True)})
SELECT o.query_id, {six('count(n.ref_id) / count(*)')} AS mapping_score
FROM old o LEFT JOIN new n ON n.query_id = o.query_id AND n.ref_id = o.ref_id GROUP BY 1"""

# ---- composition ------------------------------------------------------------------------------------

CONTRASTS = f"""{MAPPED},
pairs AS (SELECT * FROM (VALUES ('C1', 'AFRICA'), ('C1', 'AMERICA'), ('C2', 'ASIA'), ('C2', 'EUROPE'), ('C3', 'EUROPE'), ('C3', 'MIDDLE EAST')) t(contrast, grp)),
comp AS (SELECT contrast, sample, grp, label_l2 AS label FROM mapped JOIN pairs USING (grp))"""
ALL_GROUPS = f"{MAPPED}, comp AS (SELECT 'ALL' AS contrast, sample, grp, label_l2 AS label FROM mapped)"
PROPS = """cnt AS (SELECT contrast, sample, grp, label, count(*) AS n FROM comp GROUP BY ALL),
props AS (
  SELECT s.contrast, s.sample, s.grp, l.label, coalesce(c.n, 0) AS n, s.total, coalesce(c.n, 0) / s.total AS prop,
         ln(((coalesce(c.n, 0) + 0.5) / (s.total + 0.5 * labels)) / (1 - (coalesce(c.n, 0) + 0.5) / (s.total + 0.5 * labels))) AS y
  FROM (SELECT contrast, sample, grp, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY ALL) s
  JOIN (SELECT contrast, label, count(*) OVER (PARTITION BY contrast) AS labels FROM (SELECT DISTINCT contrast, label FROM cnt)) l USING (contrast)
  LEFT JOIN cnt c ON c.contrast = s.contrast AND c.sample = s.sample AND c.grp = s.grp AND c.label = l.label),
groups AS (SELECT contrast, label, grp, count(*) AS m, avg(y) AS mean_y, coalesce(var_samp(y) * (count(*) - 1), 0) AS ss, avg(prop) AS mean_prop, sum(n) AS cells
           FROM props GROUP BY ALL),
base AS (SELECT contrast, label, sum(cells) / sum(sum(cells)) OVER (PARTITION BY contrast) AS baseline_prop FROM groups GROUP BY contrast, label)"""
ORACLE["sample_proportions"] = f"WITH {ALL_GROUPS}, {PROPS} SELECT contrast, sample, grp, label, n, total, {six('prop')} AS prop FROM props"
ORACLE["logit_proportions"] = f"""WITH {CONTRASTS}, {PROPS}
SELECT contrast, sample, grp, label, n, total, {six('prop')} AS prop, {six('y')} AS y FROM props"""
ORACLE["asin_proportions"] = f"""WITH {CONTRASTS}, {PROPS}
SELECT contrast, sample, grp, label, n, total, {six('prop')} AS prop, {six('asin(sqrt(prop))')} AS y FROM props"""
ORACLE["composition_ttest"] = f"""WITH {CONTRASTS}, {PROPS},
t AS (
  SELECT contrast, label, a.grp AS group_1, b.grp AS group_2, baseline_prop, a.mean_prop AS prop_mean_1, b.mean_prop AS prop_mean_2,
         a.m + b.m - 2 AS df, (a.ss + b.ss) / nullif(a.m + b.m - 2, 0) AS s2, a.mean_y - b.mean_y AS effect, sqrt(1 / a.m + 1 / b.m) AS scale
  FROM groups a JOIN groups b USING (contrast, label) JOIN base USING (contrast, label) WHERE a.grp < b.grp)
SELECT contrast, label, group_1, group_2, {six('baseline_prop')} AS baseline_prop, {six('prop_mean_1')} AS prop_mean_1,
  {six('prop_mean_2')} AS prop_mean_2, {six('prop_mean_1 / nullif(prop_mean_2, 0)')} AS prop_ratio, CAST(df AS DOUBLE) AS df_residual,
  {six('s2')} AS s2, {six('effect')} AS effect, CASE WHEN s2 > 0 THEN {six('effect / (sqrt(s2) * scale)')} END AS t_stat FROM t"""
ORACLE["composition_anova"] = f"""WITH {ALL_GROUPS}, {PROPS},
g AS (SELECT *, sum(m * mean_y) OVER (PARTITION BY contrast, label) / sum(m) OVER (PARTITION BY contrast, label) AS grand FROM groups),
t AS (SELECT contrast, label, sum(m * pow(mean_y - grand, 2)) AS b, sum(ss) AS w, count(*) - 1 AS df1, sum(m) - count(*) AS df2 FROM g GROUP BY ALL)
SELECT contrast, label, {six('baseline_prop')} AS baseline_prop, CAST(df1 AS DOUBLE) AS df_between, CAST(df2 AS DOUBLE) AS df_residual,
  {six('w / df2')} AS s2, {six('b / df1')} AS mean_square, CASE WHEN w > 0 THEN {six('(b / df1) / (w / df2)')} END AS f_stat
FROM t JOIN base USING (contrast, label)"""
ORACLE["bh_adjusted"] = f"""WITH {MAPPED}, p AS (SELECT cell_id, grp, score_l3 AS p_value FROM mapped)
SELECT cell_id, grp, {six('p_value')} AS p_value, {six('p_adj')} AS p_adj FROM {adjusted('p', 'grp')}"""

# ---- expression cohorts --------------------------------------------------------------------------------

ORACLE["cells_by_cluster_disease"] = f"WITH {CELLS} SELECT cluster, disease, count(*) AS n FROM cells WHERE condition = 'BUILDING' GROUP BY ALL"
ORACLE["trim_genes_min_cells"] = f"""WITH {EXPR} SELECT gene, cell_id, value FROM expr
WHERE gene IN (SELECT gene FROM expr GROUP BY 1 HAVING count(*) FILTER (value > 0) > 300)"""
ORACLE["trim_genes_min_fraction"] = f"""WITH {EXPR} SELECT gene, cell_id, value FROM expr WHERE gene IN (
  SELECT gene FROM expr GROUP BY 1 HAVING count(*) FILTER (value > 0) / ((SELECT count(*) FROM customer) + 1) > 0.20)"""
ORACLE["cluster_cohorts"] = f"""WITH {CELLS}, n(cohort, cluster, condition) AS (
  VALUES ('B', 7, 'BUILDING'), ('T', 3, 'MACHINERY'), ('mim1', 1, 'BUILDING'), ('mim8', 8, 'BUILDING'))
SELECT cohort, cell_id FROM cells JOIN n USING (cluster, condition)"""
ORACLE["marker_positive_cells"] = f"""WITH {EXPR}
SELECT CASE gene WHEN 'Brand#2/LARGE' THEN 'CD20' ELSE 'CD69' END AS cohort, cell_id, value FROM expr
WHERE gene IN ('Brand#2/LARGE', 'Brand#1/SMALL') AND value > 0"""
ORACLE["marker_prevalence"] = f"""WITH {EXPR}, {CELLS},
t AS (SELECT cluster, count(*) AS tot_cluster FROM cells GROUP BY 1),
p AS (SELECT cluster, count(*) AS positive FROM cells WHERE cell_id IN (SELECT cell_id FROM expr WHERE gene = 'Brand#2/LARGE' AND value > 0) GROUP BY 1)
SELECT cluster, positive, tot_cluster, {six('positive / tot_cluster')} AS prop FROM p LEFT JOIN t USING (cluster)"""
ORACLE["panel_coexpression"] = f"""WITH {EXPR},
panel AS (SELECT 'Brand#' || b || '/' || t AS gene FROM (SELECT unnest([1, 2, 3]) AS b) CROSS JOIN (SELECT unnest(['LARGE', 'SMALL', 'PROMO']) AS t)),
seen AS (SELECT gene, count(*) FILTER (value > 0) AS n FROM expr
  WHERE cell_id IN (SELECT cell_id FROM expr WHERE gene = 'Brand#2/LARGE' AND value > 0) GROUP BY gene)
SELECT gene, coalesce(n, 0) AS positive_cells FROM panel LEFT JOIN seen USING (gene)"""
ORACLE["depletion_dims"] = f"""WITH {MEMBERS}, present AS (SELECT DISTINCT cell_id FROM expr)
SELECT cohort, (SELECT count(DISTINCT gene) FROM expr) AS genes, (SELECT count(*) FROM present) AS cells_before,
  (SELECT count(*) FROM present) - (SELECT count(DISTINCT m.cell_id) FROM members m JOIN present USING (cell_id) WHERE m.cohort = listed.cohort) AS cells_after
FROM listed"""

# ---- networks ---------------------------------------------------------------------------------------------

ORACLE["qc_filter"] = f"""WITH {EXPR},
kept AS (SELECT cell_id FROM expr GROUP BY 1 HAVING sum(value) >= 600
         AND coalesce(sum(value) FILTER (ends_with(gene, 'PROMO')), 0) <= 0.25 * sum(value)),
e AS (SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM kept))
SELECT gene, cell_id, value FROM e WHERE gene IN (
  SELECT gene FROM e GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 0.2 * (SELECT count(*) FROM kept))"""
ORACLE["cpm_normalize"] = f"""WITH {EXPR}
SELECT gene, cell_id, {six('value / sum(value) OVER (PARTITION BY cell_id) * 1e6')} AS value FROM expr"""


def subsamples(replicates: int) -> str:
    return f"""samples AS (
  SELECT net, cell_id, place - 1 AS pos FROM (
    SELECT net, c_custkey AS cell_id, CAST(row_number() OVER (PARTITION BY net ORDER BY md5('1/' || CAST(net AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR)), c_custkey) AS INTEGER) AS place
    FROM customer CROSS JOIN (SELECT CAST(unnest(range(1, {replicates + 1})) AS INTEGER) AS net)) WHERE place <= 500)"""


ORACLE["cell_subsamples"] = f"WITH {subsamples(5)} SELECT net, cell_id, pos FROM samples"


def moments(source: str, cells: str, name: str) -> str:
    """Pair moments g1 <= g2 of every net in ``source``(net, gene, cell_id, value)."""
    return f"""{name}_g AS (SELECT net, gene, sum(value) AS s, sum(value * value) AS ss FROM {source} GROUP BY 1, 2),
{name}_n AS (SELECT net, count(*) AS n FROM {cells} GROUP BY 1),
{name}_x AS (SELECT a.net, a.gene AS g1, b.gene AS g2, sum(a.value * b.value) AS sxy FROM {source} a
  JOIN {source} b ON a.net = b.net AND a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY 1, 2, 3),
{name} AS (SELECT a.net, a.gene AS g1, b.gene AS g2, n, a.s AS s1, b.s AS s2, a.ss AS ss1, b.ss AS ss2, coalesce(sxy, 0) AS sxy
  FROM {name}_g a JOIN {name}_g b ON a.net = b.net AND a.gene <= b.gene JOIN {name}_n k ON k.net = a.net
  LEFT JOIN {name}_x x ON x.net = a.net AND x.g1 = a.gene AND x.g2 = b.gene)"""


PASSED = f"""{EXPR},
tot AS (SELECT cell_id, sum(value) AS depth, count(*) FILTER (value > 0) AS genes, sum(CASE WHEN regexp_matches(gene, 'PROMO$') THEN value ELSE 0 END) AS mito
        FROM expr GROUP BY 1 HAVING sum(value) >= 400),
q AS (SELECT quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.75) AS q3 FROM tot),
usual AS (SELECT tot.* FROM tot, q WHERE depth BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
fit AS (SELECT count(*) AS n, avg(depth) AS x, regr_sxx(genes, depth) AS sxx, regr_slope(genes, depth) AS bg, avg(genes) AS yg,
               sqrt(greatest(0, regr_syy(genes, depth) - regr_slope(genes, depth) * regr_sxy(genes, depth)) / (count(*) - 2)) AS sg,
               regr_slope(mito, depth) AS bm, avg(mito) AS ym,
               sqrt(greatest(0, regr_syy(mito, depth) - regr_slope(mito, depth) * regr_sxy(mito, depth)) / (count(*) - 2)) AS sm FROM usual),
kept AS (SELECT cell_id FROM usual, fit
  WHERE abs(genes - (yg + bg * (depth - x))) <= 1.959964 * sg * sqrt(1 + 1 / n + pow(depth - x, 2) / sxx) + 1e-9
    AND abs(mito - (ym + bm * (depth - x))) <= 1.959964 * sm * sqrt(1 + 1 / n + pow(depth - x, 2) / sxx) + 1e-9
    AND mito <= 0.25 * depth),
rows_ AS (SELECT * FROM expr SEMI JOIN kept USING (cell_id)),
passed AS (SELECT gene, cell_id, value FROM rows_ WHERE gene IN (
  SELECT gene FROM rows_ GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 0.2 * (SELECT count(*) FROM kept)))"""
ORACLE["qc_outliers"] = f"WITH {PASSED} SELECT gene, cell_id, value FROM passed"


def correlations(source: str, name: str) -> str:
    return f"""{name} AS (SELECT net, g1 AS src, g2 AS dst,
    CASE WHEN n * ss1 - s1 * s1 > 0 AND n * ss2 - s2 * s2 > 0
         THEN (n * sxy - s1 * s2) / sqrt((n * ss1 - s1 * s1) * (n * ss2 - s2 * s2)) END AS w FROM {source} WHERE g1 < g2)"""


def strongest(source: str, name: str, quantile: float = 0.95) -> str:
    return f"""{name} AS (SELECT net, src, dst, w FROM {source}
  JOIN (SELECT net, quantile_cont(abs(w), {quantile}) AS edge FROM {source} WHERE w IS NOT NULL GROUP BY 1) USING (net) WHERE abs(w) >= edge)"""


def difference(x: str, y: str) -> str:
    return f"""SELECT net, gene, {six('sqrt(sum(d))')} AS distance, count(*) AS edges FROM (
  SELECT coalesce(a.net, b.net) AS net, unnest([coalesce(a.src, b.src), coalesce(a.dst, b.dst)]) AS gene,
         pow(coalesce(a.w, 0) - coalesce(b.w, 0), 2) AS d
  FROM {x} a FULL JOIN {y} b ON a.net = b.net AND a.src = b.src AND a.dst = b.dst) GROUP BY 1, 2"""


WHOLE = f"""{EXPR}, {CELLS}, whole_e AS (SELECT 'ALL' AS net, * FROM expr), whole_c AS (SELECT 'ALL' AS net, cell_id FROM cells),
{moments('whole_e', 'whole_c', 'mom')}"""
ORACLE["gene_covariance"] = f"""WITH {WHOLE}
SELECT net, g1, g2, {six('(sxy - s1 * s2 / n) / (n - 1)')} AS covariance FROM mom"""
ORACLE["gene_correlation"] = f"""WITH {WHOLE}, {correlations('mom', 'cor')} SELECT net, src, dst, {six('w')} AS w FROM cor"""
REPLICATES = f"""{EXPR}, {subsamples(REPLICATE_COUNT)}, rep_e AS (SELECT net, gene, cell_id, value FROM expr JOIN samples USING (cell_id)),
{moments('rep_e', 'samples', 'mom')}, {correlations('mom', 'cor')}, {strongest('cor', 'strong')}"""
ORACLE["edge_quantile_filter"] = f"WITH {REPLICATES} SELECT net, src, dst, {six('w')} AS w FROM strong"
ORACLE["consensus_network"] = f"""WITH {REPLICATES}
SELECT src, dst, {six(f'sum(w) / {REPLICATE_COUNT}')} AS w, count(*) AS replicates FROM strong GROUP BY 1, 2"""
ORACLE["virtual_knockout"] = f"""WITH {WHOLE}, {correlations('mom', 'cor')},
e AS (SELECT src, dst, w FROM cor UNION ALL SELECT dst, src, w FROM cor)
SELECT src, dst, {six('w')} AS w FROM e WHERE src <> 'Brand#2/LARGE'"""
ORACLE["edge_difference"] = f"""WITH {REPLICATES},
duos AS (SELECT a.net AS one, b.net AS two FROM (SELECT DISTINCT net FROM strong) a JOIN (SELECT DISTINCT net FROM strong) b ON a.net < b.net),
one AS (SELECT one || ' vs ' || two AS net, src, dst, w FROM strong JOIN duos ON net = one),
two AS (SELECT one || ' vs ' || two AS net, src, dst, w FROM strong JOIN duos ON net = two)
{difference('one', 'two')}"""
ORACLE["null_comparison"] = f"""WITH {WHOLE}, {correlations('mom', 'cor')}, {strongest('cor', 'strong', 0.9)}
{difference('strong', 'strong')}"""
ORACLE["depletion_contrasts"] = f"""WITH {MEMBERS},
nets AS (SELECT unnest(['B', 'CD20', 'T']) AS net),
full_e AS (SELECT net, gene, cell_id, value FROM nets CROSS JOIN expr), full_c AS (SELECT net, cell_id FROM nets CROSS JOIN cells),
less_c AS (SELECT * FROM full_c f WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.cohort = f.net AND m.cell_id = f.cell_id)),
less_e AS (SELECT e.* FROM full_e e JOIN less_c USING (net, cell_id)),
{moments('full_e', 'full_c', 'mx')}, {moments('less_e', 'less_c', 'my')},
{correlations('mx', 'cx')}, {correlations('my', 'cy')}, {strongest('cx', 'sx', 0.9)}, {strongest('cy', 'sy', 0.9)}
{difference('sx', 'sy')}"""
ORACLE["null_study"] = f"WITH {PASSED} SELECT DISTINCT 'null' AS dataset, gene, 0.0::DOUBLE AS distance FROM passed"
ORACLE["differential_regulation"] = f"""WITH {VECTORS},
d AS (SELECT 'vectors' AS dataset, CAST(cell_id AS VARCHAR) AS gene, list_distance(v[1:32], v[33:64]) AS distance FROM vectors)
SELECT dataset, gene, {six('distance')} AS distance, {six("distance * distance / (SELECT avg(distance * distance) FROM d WHERE gene <> '0')")} AS fc FROM d"""
DIFFREG = """diffreg AS (
  SELECT 'parts' AS dataset, p_name AS gene, p_retailprice / 1000 AS distance,
         pow(p_retailprice / 1000, 2) / avg(pow(p_retailprice / 1000, 2)) OVER () AS fc,
         row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) / (count(*) OVER () + 1) AS p_value FROM part)"""
ORACLE["significant_genes"] = f"""WITH {DIFFREG} SELECT dataset, gene, {six('distance')} AS distance, {six('fc')} AS fc,
  {six('p_value')} AS p_value, {six('log2(fc)')} AS log2fc FROM diffreg WHERE p_value < 0.05"""
ORACLE["volcano_table"] = f"""WITH {DIFFREG} SELECT dataset, gene, {six('log2(fc)')} AS log2fc, {six('-ln(p_value)')} AS neg_log_p,
  CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END AS flag, CASE WHEN p_value < 0.05 THEN gene END AS text_label FROM diffreg"""

# ---- enrichment ------------------------------------------------------------------------------------------------

ORACLE["rank_genes"] = f"WITH {DIFFREG} SELECT dataset, gene, {six('avg(distance)')} AS stat FROM diffreg GROUP BY 1, 2"
ORACLE["top_ranked_genes"] = f"""WITH {DIFFREG} SELECT dataset, gene, {six('avg(distance)')} AS stat FROM diffreg
GROUP BY 1, 2 ORDER BY round(avg(distance), 9) DESC, gene LIMIT 6"""
ORACLE["gene_set_sizes"] = f"WITH {RANKS} SELECT dataset, collection, set_name, size FROM sizes"
ORACLE["enrichment_score"] = f"""WITH {RANKS} SELECT dataset, collection, set_name, size, universe, {six('max(score)')} AS es
FROM {running('hits', 'dataset, collection, set_name')} GROUP BY ALL"""
ORACLE["running_score_curve"] = f"""WITH {RANKS}
SELECT dataset, collection, set_name, gene, rank, {six('before')} AS before, {six('score')} AS score
FROM {running('hits', 'dataset, collection, set_name')}"""
LEADING = f"""curve AS (SELECT * FROM {running('hits', 'dataset, collection, set_name')}),
tops AS (SELECT *, max(round(score, 9)) OVER (PARTITION BY dataset, collection, set_name) AS top FROM curve),
peaks AS (SELECT dataset, collection, set_name, min(rank) FILTER (round(score, 9) = top) AS peak_rank FROM tops GROUP BY 1, 2, 3),
edge_genes AS (
  SELECT dataset, collection, set_name, string_agg(gene, '|' ORDER BY rank) AS leading_edge_text
  FROM curve JOIN peaks USING (dataset, collection, set_name) WHERE rank <= peak_rank GROUP BY 1, 2, 3)"""
ORACLE["leading_edge"] = f"WITH {RANKS}, {LEADING} SELECT * FROM edge_genes"
GSEA = f"""{RANKS},
es AS (SELECT dataset, collection, set_name, size, round(max(score), 9) AS es FROM {running('hits', 'dataset, collection, set_name')} GROUP BY ALL),
draws AS (
  SELECT dataset, perm, gene, stat, rank, universe,
         row_number() OVER (PARTITION BY dataset, perm ORDER BY md5('{SEED}/' || CAST(perm AS VARCHAR) || '/' || gene), gene) AS draw
  FROM ordered CROSS JOIN (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS perm)),
drawn AS (SELECT d.*, s.size FROM draws d JOIN (SELECT DISTINCT dataset, size FROM es) s ON s.dataset = d.dataset AND d.draw <= s.size),
nulls AS (SELECT dataset, perm, size, round(max(score), 9) AS null_es FROM {running('drawn', 'dataset, perm, size')} GROUP BY 1, 2, 3),
tests AS (
  SELECT dataset, collection, set_name, size, es, CASE WHEN avg(null_es) FILTER (null_es >= 0) > 0 THEN es / avg(null_es) FILTER (null_es >= 0) END AS nes,
         CASE WHEN es IS NOT NULL THEN (1 + count(*) FILTER (null_es >= es)) / (1 + count(null_es)) END AS p_value
  FROM es JOIN nulls USING (dataset, size) GROUP BY dataset, collection, set_name, size, es),
placed AS (
  SELECT dataset, collection, set_name, size, {six('es')} AS es, {six('nes')} AS nes, {six('p_value')} AS p_value, {six('p_adj')} AS p_adj,
         round(p_adj, 12) AS by_p, round(abs(nes), 9) AS by_nes
  FROM {adjusted('tests', 'dataset')}),
gsea AS (SELECT * EXCLUDE (by_p, by_nes) FROM placed)"""
ORACLE["gsea_permutation"] = f"WITH {GSEA} SELECT * FROM gsea"
ORACLE["gsea_table"] = f"""WITH {GSEA}, {LEADING}
SELECT placed.* EXCLUDE (by_p, by_nes), leading_edge_text, CAST(row_number() OVER (PARTITION BY dataset ORDER BY by_p ASC NULLS LAST, by_nes DESC NULLS LAST, collection, set_name) AS INTEGER) AS place
FROM placed LEFT JOIN edge_genes USING (dataset, collection, set_name)"""
ORACLE["top_sets_with_ties"] = f"""WITH {GSEA} SELECT dataset, collection, set_name, p_adj FROM (
  SELECT *, rank() OVER (PARTITION BY dataset ORDER BY by_p NULLS FIRST) AS place FROM placed) WHERE place <= 9"""
ORACLE["top_sets_limit"] = f"""WITH {GSEA} SELECT dataset, collection, set_name, p_adj, nes FROM placed
ORDER BY by_p ASC NULLS LAST, by_nes DESC NULLS LAST, collection, set_name, dataset LIMIT 9"""
ORACLE["conditional_enrichment"] = f"""WITH {RANKS},
h AS (SELECT dataset, set_name, gene, stat, rank, universe, size FROM hits),
a AS (SELECT dataset, set_name AS set_a, gene, stat, rank, universe, size AS size_a, row_number() OVER (PARTITION BY dataset, set_name ORDER BY rank) AS pos FROM h),
meet AS (SELECT a.dataset, a.set_a, b.set_name AS set_b, a.pos, a.size_a, b.size AS size_b, b.stat, count(*) OVER (PARTITION BY a.dataset, a.set_a, b.set_name) AS shared
         FROM a JOIN h b ON b.dataset = a.dataset AND b.gene = a.gene WHERE a.set_a <> b.set_name),
pairs AS (SELECT DISTINCT dataset, set_a, set_b, size_a, size_b, shared FROM meet),
ins AS (SELECT dataset, set_a, set_b, stat, pos AS rank, size_a AS universe, shared AS size FROM meet),
es_in AS (SELECT dataset, set_a, set_b, size, round(max(score), 9) AS es FROM {running('ins', 'dataset, set_a, set_b')} GROUP BY 1, 2, 3, 4),
outs AS (
  SELECT p.dataset, p.set_a, p.set_b, b.stat, b.rank - (SELECT count(*) FROM a x WHERE x.dataset = p.dataset AND x.set_a = p.set_a AND x.rank < b.rank) AS rank,
         b.universe - p.size_a AS universe, p.size_b - p.shared AS size
  FROM pairs p JOIN h b ON b.dataset = p.dataset AND b.set_name = p.set_b
  WHERE p.size_b > p.shared AND NOT EXISTS (SELECT 1 FROM a x WHERE x.dataset = p.dataset AND x.set_a = p.set_a AND x.gene = b.gene)),
es_out AS (SELECT dataset, set_a, set_b, size, round(max(score), 9) AS es FROM {running('outs', 'dataset, set_a, set_b')} GROUP BY 1, 2, 3, 4),
perms AS (SELECT unnest(range(1, {CONDITIONAL_PERMUTATIONS + 1})) AS perm),
din AS (SELECT dataset, set_a, perm, stat, pos AS rank, size_a AS universe,
          row_number() OVER (PARTITION BY dataset, set_a, perm ORDER BY md5('{SEED}/' || CAST(perm AS VARCHAR) || '/' || gene), gene) AS draw FROM a CROSS JOIN perms),
din2 AS (SELECT d.*, s.size FROM din d JOIN (SELECT DISTINCT dataset, set_a, size FROM es_in) s ON s.dataset = d.dataset AND s.set_a = d.set_a AND d.draw <= s.size),
null_in AS (SELECT dataset, set_a, perm, size, round(max(score), 9) AS null_es FROM {running('din2', 'dataset, set_a, perm, size')} GROUP BY 1, 2, 3, 4),
rest AS (
  SELECT s.dataset, s.set_a, o.gene, o.stat, o.universe - s.size_a AS universe,
         row_number() OVER (PARTITION BY s.dataset, s.set_a ORDER BY o.rank) AS rank
  FROM (SELECT DISTINCT dataset, set_a, size_a FROM a) s JOIN ordered o ON o.dataset = s.dataset
  WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.dataset = s.dataset AND x.set_a = s.set_a AND x.gene = o.gene)),
dout AS (SELECT dataset, set_a, perm, stat, rank, universe,
           row_number() OVER (PARTITION BY dataset, set_a, perm ORDER BY md5('{SEED}/' || CAST(perm AS VARCHAR) || '/' || gene), gene) AS draw FROM rest CROSS JOIN perms),
dout2 AS (SELECT d.*, s.size FROM dout d JOIN (SELECT DISTINCT dataset, set_a, size FROM es_out) s ON s.dataset = d.dataset AND s.set_a = d.set_a AND d.draw <= s.size),
null_out AS (SELECT dataset, set_a, perm, size, round(max(score), 9) AS null_es FROM {running('dout2', 'dataset, set_a, perm, size')} GROUP BY 1, 2, 3, 4),
pin AS (SELECT dataset, set_a, set_b, es, CASE WHEN es IS NOT NULL THEN (1 + count(*) FILTER (null_es >= es)) / (1 + count(null_es)) END AS p
        FROM es_in JOIN null_in USING (dataset, set_a, size) GROUP BY 1, 2, 3, 4),
pout AS (SELECT dataset, set_a, set_b, es, CASE WHEN es IS NOT NULL THEN (1 + count(*) FILTER (null_es >= es)) / (1 + count(null_es)) END AS p
         FROM es_out JOIN null_out USING (dataset, set_a, size) GROUP BY 1, 2, 3, 4)
SELECT p.dataset, p.set_a, p.set_b, p.shared, {six('pin.es')} AS es_inside, {six('pin.p')} AS p_inside,
  {six('pout.es')} AS es_outside, {six('pout.p')} AS p_outside
FROM pairs p LEFT JOIN pin USING (dataset, set_a, set_b) LEFT JOIN pout USING (dataset, set_a, set_b)"""
COLLAPSE = f"""cond AS ({ORACLE["conditional_enrichment"]}),
table_ AS (WITH {GSEA} SELECT dataset, collection, set_name, size, es, nes, p_value, p_adj,
  row_number() OVER (PARTITION BY dataset ORDER BY by_p ASC NULLS LAST, by_nes DESC NULLS LAST, collection, set_name) AS place,
  rank() OVER (PARTITION BY dataset ORDER BY by_p NULLS FIRST) AS tie FROM placed),
weak AS (SELECT w.dataset, f.set_name AS set_a, w.set_name FROM table_ w JOIN table_ f ON f.dataset = w.dataset AND f.place = 1
  WHERE w.place > 1 AND coalesce(w.p_value, 1) > 0.2
    AND NOT EXISTS (SELECT 1 FROM cond c WHERE c.dataset = w.dataset AND c.set_a = f.set_name AND c.set_b = w.set_name)),
absorbs AS (SELECT dataset, set_a, set_b AS set_name FROM cond WHERE least(coalesce(p_inside, 1), coalesce(p_outside, 1)) > 0.2
  UNION SELECT * FROM weak),
edges AS (SELECT e.dataset, e.set_a, a.place AS place_a, e.set_name, b.place FROM absorbs e
  JOIN table_ a ON a.dataset = e.dataset AND a.set_name = e.set_a JOIN table_ b ON b.dataset = e.dataset AND b.set_name = e.set_name),
facing AS (SELECT t.dataset, t.place, t.set_name, coalesce(list(e.place_a) FILTER (e.place_a < t.place), []) AS absorbers
  FROM table_ t LEFT JOIN edges e ON e.dataset = t.dataset AND e.set_name = t.set_name GROUP BY ALL),
walk AS (
  SELECT dataset, CAST(1 AS BIGINT) AS place, [CAST(1 AS BIGINT)] AS walkers FROM facing WHERE place = 1
  UNION ALL
  SELECT f.dataset, f.place, CASE WHEN list_has_any(f.absorbers, w.walkers) THEN w.walkers ELSE list_append(w.walkers, f.place) END
  FROM walk w JOIN facing f ON f.dataset = w.dataset AND f.place = w.place + 1),
walkers AS (SELECT dataset, unnest(arg_max(walkers, place)) AS place_a FROM walk GROUP BY dataset),
parents AS (SELECT dataset, set_name, arg_min(set_a, place_a) AS parent FROM edges JOIN walkers USING (dataset, place_a) GROUP BY 1, 2),
collapsed AS (SELECT t.dataset, t.set_name, parent IS NULL AS is_main, parent FROM table_ t LEFT JOIN parents USING (dataset, set_name))"""
ORACLE["collapse_sets"] = f"WITH RECURSIVE {COLLAPSE} SELECT * FROM collapsed"
ORACLE["collapse_by_rounds"] = ORACLE["collapse_sets"]
ORACLE["nonredundant_table"] = f"""WITH RECURSIVE {COLLAPSE}, edge_text AS ({ORACLE["leading_edge"]}),
mains AS (SELECT t.* EXCLUDE (place, tie), by_place, by_tie FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.dataset ORDER BY t.place) AS by_place, rank() OVER (PARTITION BY t.dataset ORDER BY t.tie) AS by_tie
  FROM table_ t JOIN collapsed c ON c.dataset = t.dataset AND c.set_name = t.set_name WHERE is_main) t)
SELECT dataset, collection, set_name, size, es, nes, p_value, p_adj, leading_edge_text, CAST(by_place AS INTEGER) AS place,
  by_tie <= 9 AS tied_top, by_place <= 9 AS first_top
FROM mains LEFT JOIN edge_text USING (dataset, collection, set_name)"""
ORA = f"""{RANKS},
chosen AS (SELECT dataset, gene FROM (SELECT *, avg(stat) OVER (PARTITION BY dataset) AS mean FROM ranks) WHERE stat > mean),
drawn AS (SELECT dataset, count(*) AS n FROM chosen GROUP BY 1),
big AS (SELECT collection, set_name, count(*) AS m FROM gene_sets GROUP BY 1, 2),
uni AS (SELECT count(DISTINCT gene) AS u FROM gene_sets),
ov AS (SELECT dataset, collection, set_name, count(*) AS k FROM chosen JOIN gene_sets USING (gene) GROUP BY 1, 2, 3),
o AS (SELECT * FROM ov JOIN big USING (collection, set_name) JOIN drawn USING (dataset) CROSS JOIN uni),
terms AS (
  SELECT dataset, collection, set_name, unnest(range(k, least(m, n) + 1)) AS i, m, n, u FROM o),
tail AS (
  SELECT dataset, collection, set_name, sum(exp(
      lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(u - m + 1) - lgamma(n - i + 1) - lgamma(u - m - n + i + 1)
      - lgamma(u + 1) + lgamma(n + 1) + lgamma(u - n + 1))) AS p
  FROM terms WHERE n - i <= u - m GROUP BY 1, 2, 3),
tests AS (
  SELECT dataset, collection, set_name, k AS overlap, m AS set_size, n AS drawn, u AS universe, least(1.0, p) AS p_value,
         CASE WHEN (n - k) * (m - k) > 0 THEN k * (u - m - n + k) / ((n - k) * (m - k)) END AS odds_ratio
  FROM o JOIN tail USING (dataset, collection, set_name)),
listed AS (
  SELECT dataset, collection, set_name, overlap, set_size, drawn, universe, {six('p_value')} AS p_value, {six('odds_ratio')} AS odds_ratio,
         {six('odds_ratio * -ln(p_value)')} AS combined_score, {six('p_adj')} AS p_adj,
         round(ln(p_value), 9) AS by_p, round(odds_ratio * -ln(p_value), 9) AS by_score
  FROM {adjusted('tests', 'dataset, collection')}),
ora AS (SELECT * EXCLUDE (by_p, by_score) FROM listed)"""
ORACLE["over_representation"] = f"WITH {ORA} SELECT * FROM ora"
ORACLE["ora_top_terms"] = f"""WITH {ORA},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, collection ORDER BY by_p, set_name) AS place FROM listed) WHERE place <= 20)
SELECT dataset, collection, substr(set_name, 1, 30) AS term, p_value, combined_score,
  CAST(row_number() OVER (PARTITION BY dataset, collection ORDER BY by_score DESC NULLS LAST, set_name) AS INTEGER) AS position FROM top"""
