"""ANSI SQL (DuckDB dialect) oracles, one per registered query.

Each string starts from the driver's pre-registered tables and rebuilds the
``transactions`` view inline, so it is an independent re-statement of the
Spark DataFrame code in :mod:`fraudlens.plans.registry`.
"""

from __future__ import annotations

TRANSACTIONS_CTE = """
base AS (
  SELECT e.user_id AS client_id, e.user_id + 100000 AS account_no, CAST(e.event_id AS VARCHAR(20)) AS operation_id,
         e.event_id AS op_num, e.event_type AS tx_type,
         CASE WHEN e.event_id % 10 < 7 THEN 'Validé' WHEN e.event_id % 10 < 9 THEN 'Echoué' ELSE 'En attente' END AS op_status,
         n.n_name AS location, CAST(e.ts AS TIMESTAMP) AS tx_ts, e.value AS amount,
         (e.event_id * 7919 + e.user_id * 104729) % 1000 AS h,
         CASE WHEN hour(e.ts) >= 22 OR hour(e.ts) < 6 THEN 1 ELSE 0 END AS night,
         CASE WHEN e.value > 100 THEN 1 ELSE 0 END AS big
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
transactions AS (
  SELECT client_id, account_no, operation_id, op_num, tx_type, op_status, location, tx_ts, amount,
         CASE WHEN h < 15 + 50 * night + 60 * big THEN 'Fraude' WHEN h < 240 THEN 'Suspect' ELSE 'Normal' END AS target,
         5 * (1000 - h) + 2000 * night + 2000 * big + 10 * ((op_num * 31) % 100) AS s10k,
         20 + (op_num * 17) % 61 AS k
  FROM base),
scored AS (
  SELECT *, CAST(s10k AS DOUBLE) / 10000 AS p_fraud,
         CAST((10000 - s10k) * k AS DOUBLE) / 1000000 AS p_suspect,
         CAST((10000 - s10k) * (100 - k) AS DOUBLE) / 1000000 AS p_normal
  FROM transactions)"""


def with_tx(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the transactions CTEs (+ optional more CTEs)."""
    ctes = TRANSACTIONS_CTE + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + body


TX9 = "client_id, account_no, operation_id, tx_type, op_status, location, tx_ts, amount, target"

ORACLE: dict[str, str] = {}


def _reg(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ----------------------------------------------------------------------------- KPIs
_reg("kpis", with_tx("""
SELECT CAST(count(*) AS BIGINT) AS n_transactions,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Fraude' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_fraude,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Suspect' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_suspect,
       round(coalesce(sum(amount), 0), 6) AS montant_total,
       min(tx_ts) AS date_min, max(tx_ts) AS date_max
FROM transactions"""))

_reg("dashboard_kpis", with_tx("""
SELECT CAST(count(*) AS BIGINT) AS n_transactions,
       CAST(count(*) FILTER (WHERE target = 'Fraude') AS BIGINT) AS n_fraudes,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Fraude' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_fraude,
       round(coalesce(sum(amount), 0), 6) AS montant_total,
       round(avg(amount), 6) AS montant_moyen,
       CAST(count(DISTINCT client_id) AS BIGINT) AS clients_uniques
FROM transactions"""))

_reg("target_distribution", with_tx("""
SELECT d.statut, CAST(coalesce(x.n, 0) AS BIGINT) AS nombre,
       round(CAST(coalesce(x.n, 0) AS DOUBLE) / greatest(t.tot, 1) * 100, 6) AS pourcentage
FROM (VALUES ('Normal'), ('Suspect'), ('Fraude')) d(statut)
LEFT JOIN (SELECT target, count(*) AS n FROM transactions GROUP BY target) x ON x.target = d.statut
CROSS JOIN (SELECT count(*) FILTER (WHERE target IN ('Normal', 'Suspect', 'Fraude')) AS tot FROM transactions) t"""))

_reg("target_share_pie", with_tx("""
SELECT d.statut, CAST(x.n AS BIGINT) AS nombre
FROM (VALUES ('Normal'), ('Suspect'), ('Fraude')) d(statut)
LEFT JOIN (SELECT target, count(*) AS n FROM transactions GROUP BY target) x ON x.target = d.statut"""))

# ----------------------------------------------------------------------------- locations
_LOC_AGG = """
locagg AS (
  SELECT location, count(*) AS vol, count(target) AS nt,
         count(*) FILTER (WHERE target = 'Normal') AS nn,
         count(*) FILTER (WHERE target = 'Suspect') AS ns,
         count(*) FILTER (WHERE target = 'Fraude') AS nf
  FROM transactions WHERE location IS NOT NULL GROUP BY location),
ranked AS (SELECT *, row_number() OVER (ORDER BY vol DESC, location) AS rang FROM locagg)"""

_reg("top_locations", with_tx("""
SELECT location, CAST(rang AS BIGINT) AS rang, CAST(vol AS BIGINT) AS nombre FROM ranked WHERE rang <= 15""", _LOC_AGG))

_reg("location_status_rate", with_tx("""
SELECT location, CAST(rang AS BIGINT) AS rang,
       round(CASE WHEN nt > 0 THEN CAST(nn AS DOUBLE) / nt END * 100, 6) AS pct_normal,
       round(CASE WHEN nt > 0 THEN CAST(ns AS DOUBLE) / nt END * 100, 6) AS pct_suspect,
       round(CASE WHEN nt > 0 THEN CAST(nf AS DOUBLE) / nt END * 100, 6) AS pct_fraude
FROM ranked WHERE rang <= 10""", _LOC_AGG))

_LOC_TYPE = """
toploc AS (SELECT location FROM ranked WHERE rang <= 10),
vol AS (SELECT t.location, t.tx_type, CAST(count(*) AS BIGINT) AS nombre
        FROM transactions t JOIN toploc USING (location)
        WHERE t.tx_type IS NOT NULL GROUP BY t.location, t.tx_type)"""

_reg("location_type_volume", with_tx("SELECT location, tx_type, nombre FROM vol", _LOC_AGG + "," + _LOC_TYPE))

_reg("location_type_rollup", with_tx("""
SELECT location, tx_type, CAST(sum(nombre) AS BIGINT) AS nombre, CAST(grouping(location, tx_type) AS BIGINT) AS niveau
FROM vol GROUP BY ROLLUP (location, tx_type)""", _LOC_AGG + "," + _LOC_TYPE))

# ----------------------------------------------------------------------------- status cross-tabs
_reg("status_by_type", with_tx("""
SELECT tx_type, target, CAST(count(*) AS BIGINT) AS nombre FROM transactions
WHERE tx_type IS NOT NULL AND target IS NOT NULL GROUP BY tx_type, target"""))

for _by, _key in (("tx_type", "target_share_by_type"), ("op_status", "target_share_by_op_status")):
    _reg(_key, with_tx(f"""
SELECT {_by}, target, CAST(n AS BIGINT) AS nombre,
       round(n * 100.0 / sum(n) OVER (PARTITION BY {_by}), 6) AS pourcentage
FROM (SELECT {_by}, target, count(*) AS n FROM transactions
      WHERE {_by} IS NOT NULL AND target IS NOT NULL GROUP BY {_by}, target) g"""))

_RATES = """
       round(CAST(count(*) FILTER (WHERE target = 'Normal') AS DOUBLE) / count(*) * 100, 6) AS pct_normal,
       round(CAST(count(*) FILTER (WHERE target = 'Suspect') AS DOUBLE) / count(*) * 100, 6) AS pct_suspect,
       round(CAST(count(*) FILTER (WHERE target = 'Fraude') AS DOUBLE) / count(*) * 100, 6) AS pct_fraude"""

_reg("status_rate_by_hour", with_tx(f"""
SELECT CAST(hour(tx_ts) AS INTEGER) AS heure, {_RATES}
FROM transactions WHERE tx_ts IS NOT NULL AND target IS NOT NULL GROUP BY hour(tx_ts)"""))

_reg("status_rate_by_weekday", with_tx(f"""
SELECT CASE d.jour_num WHEN 0 THEN 'Lundi' WHEN 1 THEN 'Mardi' WHEN 2 THEN 'Mercredi' WHEN 3 THEN 'Jeudi'
                       WHEN 4 THEN 'Vendredi' WHEN 5 THEN 'Samedi' ELSE 'Dimanche' END AS jour,
       d.jour_num, g.pct_normal, g.pct_suspect, g.pct_fraude
FROM (SELECT CAST(range AS INTEGER) AS jour_num FROM range(7)) d
LEFT JOIN (SELECT CAST(isodow(tx_ts) - 1 AS INTEGER) AS jour_num, {_RATES}
           FROM transactions WHERE tx_ts IS NOT NULL AND target IS NOT NULL GROUP BY isodow(tx_ts)) g
ON d.jour_num = g.jour_num"""))

_reg("daily_trend", with_tx("""
SELECT CAST(tx_ts AS DATE) AS jour, target, CAST(count(*) AS BIGINT) AS nombre
FROM transactions WHERE tx_ts IS NOT NULL AND target IS NOT NULL GROUP BY CAST(tx_ts AS DATE), target"""))

# ----------------------------------------------------------------------------- correlations
_CORR_NAMES = ["montant", "montant_log", "heure", "jour_semaine", "est_weekend",
               "nb_transactions_client", "est_fraude", "est_suspect_ou_fraude"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_NAMES):
        for b in _CORR_NAMES[i:]:
            a2 = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            b2 = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            expr = (f"CASE WHEN stddev_pop({a2}) * stddev_pop({b2}) > 0 THEN "
                    f"covar_pop({a2}, {b2}) / (stddev_pop({a2}) * stddev_pop({b2})) END")
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, round({expr}, 6) AS r FROM num")
            if a != b:
                parts.append(f"SELECT '{b}' AS var_x, '{a}' AS var_y, round({expr}, 6) AS r FROM num")
    ctes = """
cc AS (SELECT client_id, count(client_id) AS c FROM transactions WHERE client_id IS NOT NULL GROUP BY client_id),
num AS (
  SELECT t.amount AS montant,
         ln(1 + CASE WHEN t.amount < 0 THEN 0 ELSE t.amount END) AS montant_log,
         CAST(hour(t.tx_ts) AS DOUBLE) AS heure,
         CAST(isodow(t.tx_ts) - 1 AS DOUBLE) AS jour_semaine,
         CAST(CASE WHEN isodow(t.tx_ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS DOUBLE) AS est_weekend,
         CAST(cc.c AS DOUBLE) AS nb_transactions_client,
         CAST(CASE WHEN t.target IS NOT DISTINCT FROM 'Fraude' THEN 1 ELSE 0 END AS DOUBLE) AS est_fraude,
         CAST(CASE WHEN t.target IN ('Suspect', 'Fraude') THEN 1 ELSE 0 END AS DOUBLE) AS est_suspect_ou_fraude
  FROM transactions t LEFT JOIN cc ON t.client_id = cc.client_id)"""
    return with_tx("\nUNION ALL\n".join(parts), ctes)


_reg("correlation_matrix", _corr_sql())

# ----------------------------------------------------------------------------- data quality
_reg("data_quality_profile", with_tx(f"""
SELECT CAST(count(*) AS BIGINT) AS n_lignes, CAST(9 AS BIGINT) AS n_colonnes,
       CAST(sum((client_id IS NULL)::INT + (account_no IS NULL)::INT + (operation_id IS NULL)::INT
              + (tx_type IS NULL)::INT + (op_status IS NULL)::INT + (location IS NULL)::INT
              + (tx_ts IS NULL)::INT + (amount IS NULL OR isnan(amount))::INT + (target IS NULL)::INT) AS BIGINT)
         AS valeurs_manquantes,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {TX9} FROM transactions)) AS BIGINT) AS doublons
FROM transactions"""))

_reg("null_counts_by_column", with_tx("""
SELECT colonne, CAST(nulls AS BIGINT) AS nulls FROM (
  SELECT count(*) FILTER (WHERE client_id IS NULL) AS client_id,
         count(*) FILTER (WHERE account_no IS NULL) AS account_no,
         count(*) FILTER (WHERE operation_id IS NULL) AS operation_id,
         count(*) FILTER (WHERE tx_type IS NULL) AS tx_type,
         count(*) FILTER (WHERE op_status IS NULL) AS op_status,
         count(*) FILTER (WHERE location IS NULL) AS location,
         count(*) FILTER (WHERE tx_ts IS NULL) AS tx_ts,
         count(*) FILTER (WHERE amount IS NULL OR isnan(amount)) AS amount,
         count(*) FILTER (WHERE target IS NULL) AS target
  FROM transactions) UNPIVOT (nulls FOR colonne IN (client_id, account_no, operation_id, tx_type, op_status,
                                                   location, tx_ts, amount, target))"""))

_reg("duplicate_rows", with_tx(f"""
SELECT {TX9}, CAST(count(*) AS BIGINT) AS occurrences FROM transactions
GROUP BY ALL HAVING count(*) > 1"""))

# ----------------------------------------------------------------------------- distributions
_reg("describe_amount", with_tx("""
SELECT statistique, round(valeur, 6) AS valeur FROM (
  SELECT 'count' AS statistique, CAST(count(amount) AS DOUBLE) AS valeur FROM transactions
  UNION ALL SELECT 'mean', avg(amount) FROM transactions
  UNION ALL SELECT 'std', stddev_samp(amount) FROM transactions
  UNION ALL SELECT 'min', min(amount) FROM transactions
  UNION ALL SELECT '25%', quantile_cont(amount, 0.25) FROM transactions
  UNION ALL SELECT '50%', quantile_cont(amount, 0.5) FROM transactions
  UNION ALL SELECT '75%', quantile_cont(amount, 0.75) FROM transactions
  UNION ALL SELECT 'max', max(amount) FROM transactions)"""))

_FREQ = """
lng AS (
  SELECT 'tx_type' AS colonne, tx_type AS valeur FROM transactions
  UNION ALL SELECT 'op_status', op_status FROM transactions
  UNION ALL SELECT 'location', location FROM transactions
  UNION ALL SELECT 'target', target FROM transactions),
freq AS (
  SELECT colonne, valeur, CAST(count(*) AS BIGINT) AS nombre FROM lng WHERE valeur IS NOT NULL GROUP BY colonne, valeur),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY colonne ORDER BY nombre DESC, valeur) AS BIGINT) AS rang FROM freq)"""

_reg("value_frequency_top30", with_tx("SELECT colonne, valeur, nombre, rang FROM rk WHERE rang <= 30", _FREQ))
_reg("value_frequency_all", with_tx("SELECT colonne, valeur, nombre FROM freq", _FREQ))

_reg("amount_histogram", with_tx("""
SELECT bin, round(lo + bin * w, 6) AS bin_min, round(lo + (bin + 1) * w, 6) AS bin_max, target,
       CAST(count(*) AS BIGINT) AS nombre
FROM (
  SELECT t.target, s.lo, s.w,
         CAST(coalesce(least(floor(CASE WHEN s.w <> 0 THEN (t.amount - s.lo) / s.w END), 19), 0) AS INTEGER) AS bin
  FROM transactions t,
       (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 20 AS w FROM transactions
        WHERE amount IS NOT NULL AND target IS NOT NULL) s
  WHERE t.amount IS NOT NULL AND t.target IS NOT NULL) x
GROUP BY bin, lo, w, target"""))

_reg("amount_box_by_target", with_tx("""
SELECT q.target, round(q1, 6) AS q1, round(med, 6) AS mediane, round(q3, 6) AS q3,
       round(min(CASE WHEN t.amount >= q1 - 1.5 * (q3 - q1) THEN t.amount END), 6) AS moustache_basse,
       round(max(CASE WHEN t.amount <= q3 + 1.5 * (q3 - q1) THEN t.amount END), 6) AS moustache_haute
FROM (SELECT target, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS med,
             quantile_cont(amount, 0.75) AS q3
      FROM transactions WHERE amount IS NOT NULL AND target IS NOT NULL GROUP BY target) q
JOIN transactions t ON t.target = q.target AND t.amount IS NOT NULL
GROUP BY q.target, q1, med, q3"""))

# ----------------------------------------------------------------------------- filters
# Fixed filter parameters of the registered filter queries (see registry.DEFAULT_FILTER).
_FILTER_SQL = """tx_ts IS NOT NULL AND tx_ts >= TIMESTAMP '2024-01-05 00:00:00' AND tx_ts < TIMESTAMP '2024-01-26 00:00:00'
  AND amount IS NOT NULL AND amount >= 5 AND amount <= 400
  AND tx_type IN ('click', 'purchase', 'view') AND target IN ('Fraude', 'Suspect', 'Normal')"""

_reg("filtered_transactions", with_tx(f"SELECT {TX9} FROM transactions WHERE {_FILTER_SQL}"))

_reg("filter_summary", with_tx(f"""
SELECT CAST((CASE WHEN min(CAST(tx_ts AS DATE)) IS NOT NULL AND (DATE '2024-01-05' <> min(CAST(tx_ts AS DATE))
                                                          OR DATE '2024-01-25' <> max(CAST(tx_ts AS DATE))) THEN 1 ELSE 0 END)
          + (CASE WHEN 5 <> min(amount) OR 400 <> max(amount) THEN 1 ELSE 0 END)
          + (CASE WHEN 3 <> count(DISTINCT tx_type) THEN 1 ELSE 0 END)
          + (CASE WHEN 3 <> count(DISTINCT target) THEN 1 ELSE 0 END) AS INTEGER) AS n_filtres_actifs,
       CAST(count(*) FILTER (WHERE {_FILTER_SQL}) AS BIGINT) AS n_affichees,
       CAST(count(*) AS BIGINT) AS n_total
FROM transactions"""))

_reg("filter_domains", with_tx("""
SELECT DISTINCT colonne, valeur FROM (
  SELECT 'tx_type' AS colonne, tx_type AS valeur FROM transactions
  UNION ALL SELECT 'op_status', op_status FROM transactions
  UNION ALL SELECT 'location', location FROM transactions
  UNION ALL SELECT 'target', target FROM transactions) WHERE valeur IS NOT NULL"""))

_reg("column_types", with_tx("SELECT colonne, type, CAST(nulls AS BIGINT) AS nulls FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS colonne, '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM transactions"
    for c, t in (("client_id", "entier"), ("account_no", "entier"), ("operation_id", "texte"), ("tx_type", "texte"),
                 ("op_status", "texte"), ("location", "texte"), ("tx_ts", "horodatage"), ("amount", "decimal"),
                 ("target", "texte"))) + ")"))

_reg("filter_bounds", with_tx("""
SELECT CAST(min(tx_ts) AS DATE) AS date_min, CAST(max(tx_ts) AS DATE) AS date_max,
       min(amount) AS montant_min, max(amount) AS montant_max FROM transactions"""))

_reg("preview20", with_tx(f"SELECT {TX9} FROM transactions ORDER BY op_num LIMIT 20"))

# ----------------------------------------------------------------------------- features
_FEAT = """
feat AS (
  SELECT *, CAST(hour(tx_ts) AS INTEGER) AS heure, CAST(isodow(tx_ts) - 1 AS INTEGER) AS jour_semaine,
         CASE WHEN isodow(tx_ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS est_weekend,
         CASE WHEN hour(tx_ts) >= 22 OR hour(tx_ts) < 6 THEN 1 ELSE 0 END AS est_nuit,
         CASE WHEN amount > -1 THEN ln(1 + amount) END AS log_montant
  FROM (SELECT * REPLACE (CASE WHEN location = 'Saint-Louis' THEN 'Saint Louis' ELSE location END AS location)
        FROM transactions))"""

_reg("features_base", with_tx("""
SELECT operation_id, location, heure, jour_semaine, est_weekend, est_nuit, round(log_montant, 6) AS log_montant
FROM feat""", _FEAT))

_reg("date_parse", with_tx("""
SELECT operation_id, ts_raw, tx_ts, CAST(hour(tx_ts) AS INTEGER) AS heure,
       CAST(isodow(tx_ts) - 1 AS INTEGER) AS jour_semaine,
       CASE WHEN isodow(tx_ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS est_weekend,
       CASE WHEN hour(tx_ts) >= 22 OR hour(tx_ts) < 6 THEN 1 ELSE 0 END AS est_nuit
FROM (SELECT operation_id, ts_raw,
             coalesce(try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S'), try_strptime(ts_raw, '%d/%m/%Y %H:%M:%S')) AS tx_ts
      FROM (SELECT operation_id,
                   CASE WHEN op_num % 17 = 0 THEN 'garbage' WHEN op_num % 23 = 0 THEN NULL
                        WHEN op_num % 5 = 1 THEN strftime(tx_ts, '%d/%m/%Y %H:%M:%S')
                        ELSE strftime(tx_ts, '%Y-%m-%d %H:%M:%S') END AS ts_raw
            FROM transactions))"""))

_reg("client_tx_count", with_tx("""
SELECT t.operation_id, t.client_id, CAST(c.n AS BIGINT) AS nb_transactions_client
FROM transactions t LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
                               WHERE client_id IS NOT NULL GROUP BY client_id) c ON t.client_id = c.client_id"""))

_TOP15 = """
top15 AS (SELECT location FROM (SELECT location, count(*) AS n FROM feat WHERE location IS NOT NULL GROUP BY location)
          ORDER BY n DESC, location LIMIT 15),
grp AS (SELECT f.*, CASE WHEN t.location IS NOT NULL THEN f.location ELSE 'Autre' END AS location_grp
        FROM feat f LEFT JOIN top15 t ON f.location = t.location)"""

_reg("location_grouping", with_tx("SELECT operation_id, location, location_grp FROM grp", _FEAT + "," + _TOP15))

_reg("one_hot_features", with_tx("""
SELECT l.operation_id, l.col || '_' || l.level AS feature, 1 AS value
FROM (SELECT operation_id, 'tx_type' AS col, tx_type AS level FROM grp
      UNION ALL SELECT operation_id, 'op_status', op_status FROM grp
      UNION ALL SELECT operation_id, 'location_grp', location_grp FROM grp) l
JOIN (SELECT 'tx_type' AS col, min(tx_type) AS first FROM grp
      UNION ALL SELECT 'op_status', min(op_status) FROM grp
      UNION ALL SELECT 'location_grp', min(location_grp) FROM grp) f ON l.col = f.col
WHERE l.level IS NOT NULL AND l.level <> f.first""", _FEAT + "," + _TOP15))

# every row has every feature of the matrix: the numbers, and 0/1 for each level but its column's first
_reg("wide_feature_matrix", with_tx("""
SELECT operation_id, 'log_montant' AS feature, round(log_montant, 6) AS valeur FROM grp
UNION ALL SELECT operation_id, 'heure', CAST(heure AS DOUBLE) FROM grp
UNION ALL SELECT operation_id, 'jour_semaine', CAST(jour_semaine AS DOUBLE) FROM grp
UNION ALL SELECT operation_id, 'est_weekend', CAST(est_weekend AS DOUBLE) FROM grp
UNION ALL SELECT operation_id, 'est_nuit', CAST(est_nuit AS DOUBLE) FROM grp
UNION ALL SELECT g.operation_id, 'nb_transactions_client', CAST(c.n AS DOUBLE) FROM grp g
          LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
                     WHERE client_id IS NOT NULL GROUP BY client_id) c ON g.client_id = c.client_id
UNION ALL SELECT operation_id, 'tx_type_' || v, CASE WHEN tx_type IS NOT DISTINCT FROM v THEN 1.0 ELSE 0.0 END
          FROM grp, (SELECT DISTINCT tx_type AS v FROM grp WHERE tx_type > (SELECT min(tx_type) FROM grp))
UNION ALL SELECT operation_id, 'op_status_' || v, CASE WHEN op_status IS NOT DISTINCT FROM v THEN 1.0 ELSE 0.0 END
          FROM grp, (SELECT DISTINCT op_status AS v FROM grp WHERE op_status > (SELECT min(op_status) FROM grp))
UNION ALL SELECT operation_id, 'location_grp_' || v, CASE WHEN location_grp IS NOT DISTINCT FROM v THEN 1.0 ELSE 0.0 END
          FROM grp, (SELECT DISTINCT location_grp AS v FROM grp WHERE location_grp > (SELECT min(location_grp) FROM grp))""",
                                    _FEAT + "," + _TOP15))

_reg("label_encode", with_tx("""
SELECT operation_id, target,
       CAST(CASE target WHEN 'Fraude' THEN 0 WHEN 'Normal' THEN 1 WHEN 'Suspect' THEN 2 END AS INTEGER) AS label,
       target AS decoded
FROM transactions"""))

_reg("score_features_new_tx", with_tx("""
SELECT n.operation_id, CASE WHEN t.location IS NOT NULL THEN n.location ELSE 'Autre' END AS location_grp,
       CAST(coalesce(c.cnt, 1) AS BIGINT) AS nb_transactions_client, n.heure, n.jour_semaine, n.est_weekend,
       n.est_nuit, round(n.log_montant, 6) AS log_montant
FROM feat n
LEFT JOIN (SELECT location FROM (SELECT location, count(*) AS k FROM feat
                                 WHERE tx_ts < TIMESTAMP '2024-01-25 00:00:00' AND location IS NOT NULL GROUP BY location)
           ORDER BY k DESC, location LIMIT 15) t ON n.location = t.location
LEFT JOIN (SELECT client_id, count(operation_id) AS cnt FROM feat
           WHERE tx_ts < TIMESTAMP '2024-01-25 00:00:00' AND client_id IS NOT NULL GROUP BY client_id) c
       ON n.client_id = c.client_id
WHERE n.tx_ts >= TIMESTAMP '2024-01-25 00:00:00'""", _FEAT))

_reg("make_ts", with_tx("""
SELECT operation_id, CAST(tx_ts AS DATE) AS jour,
       make_timestamp(year(tx_ts), month(tx_ts), day(tx_ts), hour(tx_ts), minute(tx_ts), second(tx_ts)) AS tx_ts_combine
FROM transactions"""))

_reg("ts_format", with_tx("""
SELECT operation_id, strftime(tx_ts, '%Y-%m-%d %H:%M:%S') AS horodatage_txt, strftime(tx_ts, '%d/%m/%y') AS periode
FROM transactions"""))

_reg("tx_json", with_tx("""
SELECT t.operation_id,
       to_json({'tx_type': coalesce(t.tx_type, 'None'), 'op_status': coalesce(t.op_status, 'None'),
                'location': coalesce(t.location, 'None'),
                'date': coalesce(strftime(t.tx_ts, '%Y-%m-%d %H:%M:%S'), 'None'),
                'amount': coalesce(CAST(t.amount AS VARCHAR), 'None'),
                'nb_transactions_client': coalesce(CAST(c.n AS VARCHAR), 'None')})::VARCHAR AS tx_json
FROM transactions t LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
                               WHERE client_id IS NOT NULL GROUP BY client_id) c ON t.client_id = c.client_id"""))

# ----------------------------------------------------------------------------- scores & metrics
_PRED = """
pred AS (SELECT *, CASE WHEN p_fraud >= 0.5 THEN 'Fraude' WHEN p_normal >= p_suspect THEN 'Normal'
                        ELSE 'Suspect' END AS predicted_status FROM scored)"""

_reg("verdict", with_tx("""
SELECT operation_id, target, round(p_fraud, 6) AS p_fraud, round(p_normal, 6) AS p_normal,
       round(p_suspect, 6) AS p_suspect, predicted_status FROM pred""", _PRED))

_reg("risk_band", with_tx("""
SELECT operation_id, round(p_fraud, 6) AS p_fraud,
       CASE WHEN p_fraud IS NULL THEN NULL WHEN p_fraud * 100 < 33 THEN 'Normal'
            WHEN p_fraud * 100 < 66 THEN 'Suspect' ELSE 'Fraude' END AS bande FROM scored"""))

_CLASSES = "(VALUES ('Fraude'), ('Normal'), ('Suspect'))"

_reg("confusion_matrix", with_tx(f"""
SELECT a.c AS reel, p.c AS predit,
       CAST((SELECT count(*) FROM pred WHERE target = a.c AND predicted_status = p.c) AS BIGINT) AS nombre
FROM {_CLASSES} a(c), {_CLASSES} p(c)""", _PRED))

_PER_CLASS = f"""
cls AS (
  SELECT c.c AS label,
         count(*) FILTER (WHERE x.target = c.c AND x.predicted_status = c.c) AS tp,
         count(*) FILTER (WHERE x.target = c.c AND x.predicted_status IN ('Fraude', 'Normal', 'Suspect')) AS support,
         count(*) FILTER (WHERE x.predicted_status = c.c AND x.target IN ('Fraude', 'Normal', 'Suspect')) AS npred
  FROM {_CLASSES} c(c) CROSS JOIN pred x GROUP BY c.c),
pc AS (
  SELECT label, support, tp,
         CASE WHEN npred > 0 THEN CAST(tp AS DOUBLE) / npred ELSE 0 END AS p,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS r
  FROM cls),
pcf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pc)"""

_reg("classification_report", with_tx("""
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score,
       round(CAST(support AS DOUBLE), 6) AS support FROM pcf
UNION ALL
SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), round(CAST(sum(support) AS DOUBLE), 6) FROM pcf
UNION ALL
SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), round(CAST(sum(support) AS DOUBLE), 6) FROM pcf
UNION ALL
SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), round(CAST(sum(support) AS DOUBLE), 6) FROM pcf""",
                                       _PRED + "," + _PER_CLASS))

_reg("model_metrics", with_tx("""
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(p), 6) AS precision_macro,
       round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro,
       round(max(CASE WHEN label = 'Fraude' THEN r END), 6) AS recall_fraude FROM pcf""", _PRED + "," + _PER_CLASS))

_COMPARISON = """
rules AS (SELECT * FROM (VALUES (0, 'seuil_0.2', 0.2), (1, 'seuil_0.35', 0.35), (2, 'seuil_0.5', 0.5),
                                (3, 'seuil_0.65', 0.65), (4, 'seuil_0.8', 0.8)) r(fit_order, model, seuil)),
judged AS (SELECT model, fit_order, target, CASE WHEN p_fraud >= CAST(seuil AS DOUBLE) THEN 'Fraude'
                  WHEN p_normal >= p_suspect THEN 'Normal' ELSE 'Suspect' END AS v FROM scored CROSS JOIN rules),
cell AS (SELECT model, fit_order, target, v, count(*) AS n FROM judged
         WHERE target IN ('Fraude', 'Normal', 'Suspect') GROUP BY ALL),
per AS (SELECT model, fit_order, c.c AS label, coalesce(sum(n) FILTER (WHERE target = c.c AND v = c.c), 0) AS tp,
               coalesce(sum(n) FILTER (WHERE target = c.c), 0) AS support,
               coalesce(sum(n) FILTER (WHERE v = c.c), 0) AS npred
        FROM cell CROSS JOIN (VALUES ('Fraude'), ('Normal'), ('Suspect')) c(c) GROUP BY model, fit_order, c.c),
pr AS (SELECT *, CASE WHEN npred > 0 THEN CAST(tp AS DOUBLE) / npred ELSE 0 END AS p,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS r FROM per),
met AS (SELECT model, fit_order, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
               round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
               round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1_macro,
               round(max(CASE WHEN label = 'Fraude' THEN r END), 6) AS recall_fraude FROM pr GROUP BY model, fit_order),
shown AS (SELECT *, CAST(row_number() OVER (ORDER BY round(recall_fraude, 4) DESC, fit_order) AS INTEGER) AS rang,
                 CAST(count(*) OVER () AS BIGINT) AS n_modeles,
                 CAST(round(CAST(accuracy * 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS accuracy_pct,
                 CAST(round(CAST(precision_macro * 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS precision_macro_pct,
                 CAST(round(CAST(recall_macro * 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS recall_macro_pct,
                 CAST(round(CAST(f1_macro * 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS f1_macro_pct,
                 CAST(round(CAST(recall_fraude * 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS recall_fraude_pct FROM met)"""

_reg("comparison_all", with_tx("SELECT * FROM shown", _COMPARISON))

_reg("comparison_subset", with_tx("SELECT * FROM shown WHERE model IN ('seuil_0.35', 'seuil_0.8')", _COMPARISON))

_BIN = """
bin AS (SELECT count(*) FILTER (WHERE target = 'Fraude' AND p_fraud >= 0.5) AS tp,
               count(*) FILTER (WHERE target IS DISTINCT FROM 'Fraude' AND p_fraud >= 0.5) AS fp,
               count(*) FILTER (WHERE target = 'Fraude' AND NOT coalesce(p_fraud >= 0.5, false)) AS fn,
               count(*) FILTER (WHERE target IS DISTINCT FROM 'Fraude' AND NOT coalesce(p_fraud >= 0.5, false)) AS tn
        FROM scored)"""

_reg("threshold_metrics", with_tx("""
SELECT CAST(0.5 AS DOUBLE) AS seuil,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS rappel,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       CAST(fn AS BIGINT) AS faux_negatifs, CAST(fp AS BIGINT) AS faux_positifs FROM bin""", _BIN))

_reg("threshold_confusion", with_tx("""
SELECT CAST(0 AS INTEGER) AS reel, CAST(0 AS INTEGER) AS predit, CAST(tn AS BIGINT) AS nombre FROM bin
UNION ALL SELECT 0, 1, fp FROM bin UNION ALL SELECT 1, 0, fn FROM bin UNION ALL SELECT 1, 1, tp FROM bin""", _BIN))

_CURVE = """
pts AS (SELECT p_fraud AS score, count(*) FILTER (WHERE target = 'Fraude') AS pos,
               count(*) FILTER (WHERE target IS DISTINCT FROM 'Fraude') AS neg
        FROM scored WHERE p_fraud IS NOT NULL GROUP BY p_fraud),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N
        FROM pts)"""

_reg("pr_curve", with_tx("""
SELECT score AS seuil, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0 END, 6) AS rappel FROM cum
UNION ALL SELECT NULL, 1.0, 0.0""", _CURVE))

_reg("roc_curve", with_tx("""
SELECT score AS seuil, round(CASE WHEN N > 0 THEN CAST(fp AS DOUBLE) / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P END, 6) AS tpr FROM cum
UNION ALL SELECT NULL, 0.0, 0.0""", _CURVE))

# a point goes if the steps to it and from it (in falling order of score) have one direction
_reg("roc_corners", with_tx("""
SELECT score AS seuil, round(CASE WHEN N > 0 THEN CAST(fp AS DOUBLE) / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P END, 6) AS tpr
FROM (SELECT *, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2 FROM cum WINDOW w AS (ORDER BY score DESC))
WHERE pos2 IS NULL OR CAST(pos AS HUGEINT) * neg2 <> CAST(neg AS HUGEINT) * pos2
UNION ALL SELECT NULL, 0.0, 0.0""", _CURVE))

_reg("top_values_high_cardinality", with_tx("""
SELECT colonne, valeur, nombre, CAST(rang AS BIGINT) AS rang
FROM (SELECT *, row_number() OVER (PARTITION BY colonne ORDER BY nombre DESC, valeur) AS rang
      FROM (SELECT 'account_no' AS colonne, CAST(account_no AS VARCHAR) AS valeur, count(*) AS nombre
            FROM transactions WHERE account_no IS NOT NULL GROUP BY account_no
            UNION ALL SELECT 'operation_id', operation_id, count(*) FROM transactions
            WHERE operation_id IS NOT NULL GROUP BY operation_id))
WHERE rang <= 30"""))

_reg("rollup_kpis", with_tx("""
SELECT CAST(count(*) AS BIGINT) AS n_transactions,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Fraude' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_fraude,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Suspect' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_suspect,
       round(coalesce(sum(amount), 0), 6) AS montant_total, round(avg(amount), 6) AS montant_moyen, true AS clients_dans_erreur
FROM transactions
WHERE CAST(tx_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND tx_type IN ('click', 'purchase', 'view')
  AND target IN ('Fraude', 'Suspect', 'Normal')"""))

_reg("roc_auc", with_tx("""
SELECT round(sum(CAST(neg * (2 * (tp - pos) + pos) AS DOUBLE)) / (2.0 * max(P) * max(N)), 6) AS auc FROM cum""", _CURVE))

_reg("best_f1_threshold", with_tx("""
SELECT score AS seuil, round(f1, 6) AS f1, round(prec, 6) AS precision, round(rec, 6) AS rappel
FROM (SELECT score, CAST(2 * tp AS DOUBLE) / (tp + fp + P) AS f1, CAST(tp AS DOUBLE) / (tp + fp) AS prec,
             CAST(tp AS DOUBLE) / P AS rec FROM cum)
ORDER BY f1 DESC, score ASC LIMIT 1""", _CURVE))

# ----------------------------------------------------------------------------- split, weights, scaling
# ceil(20 %) of all rows; classes get their share, rounded by the largest remainder (ties by name)
_SPLIT = """
cls AS (
  SELECT target, count(*) AS nc, sum(count(*)) OVER () AS nt, ceil(0.2 * sum(count(*)) OVER ()) AS tt
  FROM transactions WHERE target IN ('Fraude', 'Normal', 'Suspect') GROUP BY target),
quota AS (
  SELECT target, floor(nc * tt / nt)
                 + CASE WHEN row_number() OVER (ORDER BY (nc * tt) % nt DESC, target)
                             <= max(tt) OVER () - sum(floor(nc * tt / nt)) OVER () THEN 1 ELSE 0 END AS q
  FROM cls),
spl AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.target ORDER BY md5(concat(operation_id, ':42')), operation_id)
              <= quota.q AS is_test
  FROM transactions t JOIN quota ON t.target = quota.target)"""

_reg("stratified_split", with_tx("SELECT operation_id, target, is_test FROM spl", _SPLIT))

_reg("cv_folds", with_tx("""
SELECT operation_id, target, CAST((rn > n * 1 // 5)::INT + (rn > n * 2 // 5)::INT + (rn > n * 3 // 5)::INT
                                  + (rn > n * 4 // 5)::INT AS INTEGER) AS fold
FROM (SELECT operation_id, target, count(*) OVER (PARTITION BY target) AS n,
             row_number() OVER (PARTITION BY target ORDER BY md5(concat(operation_id, ':43')), operation_id) AS rn
      FROM spl WHERE NOT is_test)""", _SPLIT))

_reg("class_weights", with_tx("""
SELECT target, CAST(n AS BIGINT) AS n_train,
       round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight
FROM (SELECT target, count(*) AS n FROM spl WHERE NOT is_test GROUP BY target)""", _SPLIT))

_reg("contamination_rate", with_tx("""
SELECT round(avg(CASE WHEN target = 'Fraude' THEN 1.0 ELSE 0.0 END), 6) AS contamination FROM spl WHERE NOT is_test""",
                                   _SPLIT))

_NUM = ["log_montant", "heure", "jour_semaine", "est_weekend", "est_nuit", "nb_transactions_client"]


def _std_sql() -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}"
                      for c in _NUM)
    cols = ", ".join(f"round((CAST(f.{c} AS DOUBLE) - s.m_{c}) / s.s_{c}, 6) AS {c}" for c in _NUM)
    ctes = _FEAT.replace("FROM transactions))", "FROM spl))") + """,
cc AS (SELECT client_id, count(operation_id) AS nb_transactions_client FROM transactions
       WHERE client_id IS NOT NULL GROUP BY client_id),
ff AS (SELECT feat.*, cc.nb_transactions_client FROM feat LEFT JOIN cc ON feat.client_id = cc.client_id),
st AS (SELECT """ + stats + " FROM ff WHERE NOT is_test)"
    return with_tx(f"SELECT f.operation_id, {cols} FROM ff f, st s", _SPLIT + "," + ctes)


_reg("standardized_features", _std_sql())

# ----------------------------------------------------------------------------- journal & runs
_JOURNAL = """
journal AS (
  SELECT tx_ts AS scored_at, operation_id, tx_type, op_status, location, tx_ts, amount, client_id, target,
         CAST(0.5 AS DOUBLE) AS threshold,
         CASE WHEN p_fraud >= 0.5 THEN 'Fraude' WHEN p_normal >= p_suspect THEN 'Normal' ELSE 'Suspect' END
           AS predicted_status,
         round(p_fraud * 100, 6) AS p_fraude, round(p_normal * 100, 6) AS p_normal,
         round(p_suspect * 100, 6) AS p_suspect
  FROM scored)"""
_JCOLS = ("scored_at, operation_id, tx_type, op_status, location, amount, threshold, predicted_status, "
          "p_fraude, p_normal, p_suspect")

_reg("journal_summary", with_tx("""
SELECT CAST(count(*) AS BIGINT) AS n_predictions,
       CAST(count(*) FILTER (WHERE predicted_status = 'Fraude') AS BIGINT) AS n_fraude,
       round(coalesce(sum(amount), 0), 6) AS montant_total,
       CAST(count(*) FILTER (WHERE predicted_status IN ('Fraude', 'Suspect')) AS BIGINT) AS n_predictions_filtre,
       CAST(count(*) FILTER (WHERE predicted_status = 'Fraude') AS BIGINT) AS n_fraude_filtre,
       round(coalesce(sum(amount) FILTER (WHERE predicted_status IN ('Fraude', 'Suspect')), 0), 6) AS montant_filtre
FROM journal""", _JOURNAL))

_reg("journal_filtered", with_tx(f"""
SELECT {_JCOLS} FROM journal WHERE predicted_status IN ('Fraude', 'Suspect') ORDER BY scored_at DESC, operation_id""",
                                  _JOURNAL))

# percentages have four decimals at most: exact as decimals, rounded half up
_reg("journal_roundtrip", with_tx("""
SELECT CASE WHEN tx_ts < TIMESTAMP '2024-01-15 00:00:00' THEN TIMESTAMP '2024-02-01 08:00:00'
            ELSE TIMESTAMP '2024-02-02 08:00:00' END AS scored_at,
       operation_id, tx_type, op_status, location, tx_ts, amount, cc.n AS client_tx_count, threshold, predicted_status,
       CAST(round(CAST(s10k AS DECIMAL(18,4)) / 100, 2) AS DOUBLE) AS p_fraude,
       CAST(round(CAST(CAST((10000 - s10k) * (100 - k) AS DECIMAL(18,4)) * 0.0001 AS DECIMAL(18,4)), 2) AS DOUBLE) AS p_normal,
       CAST(round(CAST(CAST((10000 - s10k) * k AS DECIMAL(18,4)) * 0.0001 AS DECIMAL(18,4)), 2) AS DOUBLE) AS p_suspect
FROM (SELECT *, CAST(0.5 AS DOUBLE) AS threshold,
             CASE WHEN p_fraud >= 0.5 THEN 'Fraude' WHEN p_normal >= p_suspect THEN 'Normal' ELSE 'Suspect' END
               AS predicted_status FROM scored)
LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
           WHERE client_id IS NOT NULL GROUP BY client_id) cc USING (client_id)"""))

_CSV_SQL = """
SELECT client_id, account_no, operation_id, tx_type, op_status, location,
       CASE WHEN op_num % 19 <> 0 THEN date_trunc('second', tx_ts) END AS tx_ts,
       CASE WHEN op_num % 13 <> 0 AND op_num % 17 <> 0 AND op_num % 29 <> 0 THEN amount END AS amount, target
FROM transactions"""
_reg("csv_roundtrip_semicolon", with_tx(_CSV_SQL))
_reg("csv_roundtrip_comma", with_tx(_CSV_SQL))
_reg("csv_quality", with_tx("""
SELECT CAST(count(*) AS BIGINT) AS n_lignes, CAST(0 AS BIGINT) AS lignes_mal_formees,
       CAST(count(*) FILTER (WHERE op_num % 29 = 0 AND op_num % 13 <> 0 AND op_num % 17 <> 0) AS BIGINT) AS nombres_illisibles,
       CAST(count(*) FILTER (WHERE op_num % 19 = 0) AS BIGINT) AS dates_illisibles
FROM transactions"""))
_reg("export_csv_roundtrip", ORACLE["filtered_transactions"])

_RUNS = """
runs AS (
  SELECT CAST(CAST(scored_at AS DATE) AS TIMESTAMP) AS horodatage, 'pseudo_score' AS model_nom,
         round(CAST(count(*) FILTER (WHERE predicted_status IS NOT DISTINCT FROM target) AS DOUBLE) / count(*), 6) AS accuracy,
         round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision_fraude,
         round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS rappel_fraude,
         round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_fraude,
         max(threshold) AS best_threshold_f1, CAST(count(*) AS BIGINT) AS n_test
  FROM (SELECT *, count(*) FILTER (WHERE target = 'Fraude' AND predicted_status = 'Fraude')
                    OVER (PARTITION BY CAST(scored_at AS DATE)) AS tp,
                  count(*) FILTER (WHERE target IS DISTINCT FROM 'Fraude' AND predicted_status = 'Fraude')
                    OVER (PARTITION BY CAST(scored_at AS DATE)) AS fp,
                  count(*) FILTER (WHERE target = 'Fraude' AND predicted_status IS DISTINCT FROM 'Fraude')
                    OVER (PARTITION BY CAST(scored_at AS DATE)) AS fn
        FROM journal WHERE scored_at IS NOT NULL)
  GROUP BY CAST(scored_at AS DATE), tp, fp, fn)"""

_reg("run_history", with_tx("""
SELECT horodatage, model_nom, accuracy, rappel_fraude, f1_fraude, best_threshold_f1, n_test,
       CAST(NULL AS DOUBLE) AS duree_entrainement_sec FROM runs""",
                            _JOURNAL + "," + _RUNS))

_reg("runs_roundtrip", with_tx("""
SELECT horodatage, model_nom, accuracy, precision_fraude, rappel_fraude, f1_fraude, CAST(NULL AS DOUBLE) AS rappel_macro,
       CAST(NULL AS DOUBLE) AS f1_macro, best_threshold_f1, CAST(NULL AS VARCHAR) AS grid_search_best_params, n_test,
       CAST(NULL AS DOUBLE) AS duree_entrainement_sec FROM runs""", _JOURNAL + "," + _RUNS))

_reg("run_deltas", with_tx("""
SELECT horodatage, accuracy, rappel_fraude, f1_fraude,
       round(accuracy - pa, 6) AS delta_accuracy, round(rappel_fraude - pr, 6) AS delta_rappel_fraude,
       round(f1_fraude - pf, 6) AS delta_f1_fraude
FROM (SELECT *, lag(accuracy) OVER (ORDER BY horodatage) AS pa, lag(rappel_fraude) OVER (ORDER BY horodatage) AS pr,
             lag(f1_fraude) OVER (ORDER BY horodatage) AS pf FROM runs)
WHERE pa IS NOT NULL""", _JOURNAL + "," + _RUNS))

# ----------------------------------------------------------------------------- streaming
_reg("streaming_scoring", with_tx(f"SELECT {_JCOLS} FROM journal", _JOURNAL))

_reg("stream_static_client_count", with_tx("""
SELECT t.operation_id, t.client_id, CAST(coalesce(c.n, 1) AS BIGINT) AS nb_transactions_client
FROM transactions t LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
                               WHERE client_id IS NOT NULL GROUP BY client_id) c ON t.client_id = c.client_id"""))

_reg("streaming_journal_kpis", with_tx("""
SELECT predicted_status, CAST(count(*) AS BIGINT) AS n_predictions, round(sum(amount), 6) AS montant_total
FROM journal GROUP BY predicted_status""", _JOURNAL))

_reg("streaming_daily_trend", with_tx("""
SELECT CAST(tx_ts AS DATE) AS jour, target, CAST(count(*) AS BIGINT) AS nombre
FROM transactions GROUP BY CAST(tx_ts AS DATE), target"""))

_reg("streaming_journal", with_tx("""
SELECT operation_id, tx_type, op_status, location, tx_ts, amount,
       CAST(greatest(coalesce(h.n, 0) + row_number() OVER (PARTITION BY s.client_id ORDER BY tx_ts, operation_id) - 1, 1)
            AS BIGINT) AS client_tx_count, threshold, predicted_status,
       CAST(round(CAST(s10k AS DECIMAL(18,4)) / 100, 2) AS DOUBLE) AS p_fraude,
       CAST(round(CAST(CAST((10000 - s10k) * (100 - k) AS DECIMAL(18,4)) * 0.0001 AS DECIMAL(18,4)), 2) AS DOUBLE) AS p_normal,
       CAST(round(CAST(CAST((10000 - s10k) * k AS DECIMAL(18,4)) * 0.0001 AS DECIMAL(18,4)), 2) AS DOUBLE) AS p_suspect,
       true AS scored_now
FROM (SELECT *, CAST(0.5 AS DOUBLE) AS threshold,
             CASE WHEN p_fraud >= 0.5 THEN 'Fraude' WHEN p_normal >= p_suspect THEN 'Normal' ELSE 'Suspect' END
               AS predicted_status FROM scored WHERE tx_ts >= TIMESTAMP '2024-01-15 00:00:00') s
LEFT JOIN (SELECT client_id, count(operation_id) AS n FROM transactions
           WHERE client_id IS NOT NULL AND tx_ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY client_id) h USING (client_id)"""))

_reg("streaming_dedup", with_tx("SELECT DISTINCT operation_id, tx_ts, amount, target FROM transactions"))


# ----------------------------------------------------------------------------- composed / single-scan EDA
_reg("target_crosstabs", with_tx("""
SELECT dimension, valeur, target, CAST(nombre AS BIGINT) AS nombre FROM (
  SELECT 'tx_type' AS dimension, tx_type AS valeur, target, count(*) AS nombre FROM transactions
  WHERE target IS NOT NULL GROUP BY tx_type, target
  UNION ALL SELECT 'op_status', op_status, target, count(*) FROM transactions
  WHERE target IS NOT NULL GROUP BY op_status, target
  UNION ALL SELECT 'heure', CAST(hour(tx_ts) AS VARCHAR), target, count(*) FROM transactions
  WHERE target IS NOT NULL GROUP BY hour(tx_ts), target
  UNION ALL SELECT 'jour_semaine', CAST(isodow(tx_ts) - 1 AS VARCHAR), target, count(*) FROM transactions
  WHERE target IS NOT NULL GROUP BY isodow(tx_ts), target
  UNION ALL SELECT 'jour', CAST(CAST(tx_ts AS DATE) AS VARCHAR), target, count(*) FROM transactions
  WHERE target IS NOT NULL GROUP BY CAST(tx_ts AS DATE), target)
WHERE valeur IS NOT NULL"""))

_reg("filtered_kpis", with_tx(f"""
SELECT CAST(count(*) AS BIGINT) AS n_transactions,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Fraude' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_fraude,
       round(coalesce(avg(CASE WHEN target IS NOT DISTINCT FROM 'Suspect' THEN 1 ELSE 0 END) * 100, 0), 6) AS taux_suspect,
       round(coalesce(sum(amount), 0), 6) AS montant_total,
       min(tx_ts) AS date_min, max(tx_ts) AS date_max
FROM transactions WHERE {_FILTER_SQL}"""))

_reg("filtered_location_status_rate", with_tx("""
SELECT location, CAST(rang AS BIGINT) AS rang,
       round(CASE WHEN nt > 0 THEN CAST(nn AS DOUBLE) / nt END * 100, 6) AS pct_normal,
       round(CASE WHEN nt > 0 THEN CAST(ns AS DOUBLE) / nt END * 100, 6) AS pct_suspect,
       round(CASE WHEN nt > 0 THEN CAST(nf AS DOUBLE) / nt END * 100, 6) AS pct_fraude
FROM ranked WHERE rang <= 10""", _LOC_AGG.replace("FROM transactions WHERE location IS NOT NULL",
                                                  f"FROM transactions WHERE location IS NOT NULL AND {_FILTER_SQL}")))

_reg("client_id_histogram", with_tx("""
SELECT bin, round(lo + bin * w, 6) AS bin_min, round(lo + (bin + 1) * w, 6) AS bin_max, target,
       CAST(count(*) AS BIGINT) AS nombre
FROM (
  SELECT t.target, s.lo, s.w,
         CAST(coalesce(least(floor(CASE WHEN s.w <> 0 THEN (CAST(t.client_id AS DOUBLE) - s.lo) / s.w END), 19), 0)
              AS INTEGER) AS bin
  FROM transactions t,
       (SELECT CAST(min(client_id) AS DOUBLE) AS lo, CAST(max(client_id) - min(client_id) AS DOUBLE) / 20 AS w
        FROM transactions WHERE client_id IS NOT NULL AND target IS NOT NULL) s
  WHERE t.client_id IS NOT NULL AND t.target IS NOT NULL) x
GROUP BY bin, lo, w, target"""))

_reg("ts_histogram", with_tx("""
SELECT date_trunc('day', tx_ts) AS bin_debut, target, CAST(count(*) AS BIGINT) AS nombre
FROM transactions WHERE tx_ts IS NOT NULL AND target IS NOT NULL GROUP BY date_trunc('day', tx_ts), target"""))
