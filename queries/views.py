"""The domain views as SQL text, for the comparison queries."""

GL = """gl AS (
  SELECT 'ORD-' || o.o_orderkey AS trx_id,
    CASE WHEN l_linestatus = 'F' OR l_returnflag = 'R' THEN '1' || l_returnflag END AS acc_debit,
    CASE WHEN l_linestatus = 'O' THEN '4' || substr(o_orderpriority, 1, 1) END AS acc_credit,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, CAST(l_shipdate AS DATE) AS trx_date,
    l_returnflag AS t_1, l_linestatus AS t_2, o_orderpriority AS t_3, o_orderstatus AS t_4,
    CAST(l_suppkey AS VARCHAR) AS t_5, 'S' || l_suppkey AS reference_1,
    l_linestatus || '/' || o_orderpriority AS description
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey)"""

TXN = """txn0 AS (
  SELECT 'TXN-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS source_rowid,
    CASE WHEN o_orderkey % 5 = 0 THEN 'CLAIM_PAID' ELSE 'PREMIUM_RECEIPT' END AS txn_type,
    'POL-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS policy_no,
    CASE o_orderstatus WHEN 'F' THEN 'LIFE01' WHEN 'O' THEN 'FAM01' ELSE 'INV01' END AS product_code,
    CASE WHEN o_orderkey % 10 < 7 THEN 'AGENCY' ELSE 'INBRANCH' END AS channel,
    CAST(o_orderdate AS DATE) AS bank_value_date,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS txn_month, 'IDR' AS currency,
    CAST(o_totalprice AS DECIMAL(20,2)) AS g, o_orderkey % 5 = 0 AS c FROM orders),
 txn1 AS (SELECT *, CAST(g AS DECIMAL(20,6)) AS gross_amount,
    CAST(round(CASE WHEN c THEN g * 0.80 ELSE g * 0.30 END, 2) AS DECIMAL(20,6)) AS tabarru_amount,
    CAST(CASE WHEN c THEN 0 ELSE round(g * 0.10, 2) END AS DECIMAL(20,6)) AS tanahud_amount,
    CAST(CASE WHEN c THEN 0 ELSE round(g * 0.08, 2) END AS DECIMAL(20,6)) AS ujroh_amount,
    CAST(round(g * 0.02, 2) AS DECIMAL(20,6)) AS admin_amount FROM txn0),
 txn AS (SELECT * EXCLUDE (g, c), CAST(CASE WHEN c THEN gross_amount - tabarru_amount + admin_amount
    ELSE gross_amount - tabarru_amount - tanahud_amount - ujroh_amount - admin_amount END
    AS DECIMAL(20,6)) AS invest_amount FROM txn1)"""

PREMIUM = """premium0 AS (SELECT o_orderkey AS txn_id,
    'POL-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS policy_id,
    CAST(o_orderdate AS DATE) AS payment_date, CAST(o_totalprice AS DECIMAL(20,2)) AS premium_amount,
    o_orderstatus = 'F' AS batch_processed FROM orders WHERE o_orderkey % 5 <> 0),
 premium AS (SELECT *, CAST(round(premium_amount * 0.40, 2) AS DECIMAL(20,2)) AS fund_tabarru,
    CAST(round(premium_amount * 0.40, 2) AS DECIMAL(20,2)) AS fund_tanahud,
    CAST(premium_amount - 2 * round(premium_amount * 0.40, 2) AS DECIMAL(20,2)) AS fund_ujroh
  FROM premium0)"""

CLAIMS = """claims AS (SELECT o_orderkey AS claim_id,
    'POL-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS policy_id,
    CAST(o_orderdate AS DATE) AS claim_date, CAST(o_totalprice AS DECIMAL(20,2)) AS claim_amount,
    CAST(round(CAST(o_totalprice AS DECIMAL(20,2)) * 0.80, 2) AS DECIMAL(20,2)) AS fund_tabarru,
    CAST(CAST(o_totalprice AS DECIMAL(20,2)) - round(CAST(o_totalprice AS DECIMAL(20,2)) * 0.80, 2) AS DECIMAL(20,2)) AS fund_tanahud,
    o_orderstatus = 'F' AS batch_processed FROM orders WHERE o_orderkey % 5 = 0)"""

LINES = """lines AS (
  SELECT l_orderkey AS journal_id, 'S0' || substr(o_orderpriority, 1, 1) || '10' AS journal_type,
    CAST(o_orderdate AS DATE) AS journal_date, l_linenumber AS line_no, l_partkey AS sort_part,
    l_suppkey AS sort_supp, CAST(l_shipdate AS DATE) AS sort_date,
    CASE WHEN l_linenumber % 2 = 1 THEN '1' ELSE '4' END || l_returnflag AS account_code,
    CASE WHEN l_linenumber % 2 = 1 THEN 'D' ELSE 'C' END AS dc,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_linenumber % 5 AS account_flag,
    l_returnflag AS t1, l_linestatus AS t2, o_orderstatus AS t3, CAST(l_suppkey AS VARCHAR) AS t4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

JOURNALS = """journals AS (
  SELECT o_orderkey AS id, 'C' || o_custkey AS source_rowid,
    'S0' || substr(o_orderpriority, 1, 1) || '10' AS journal_type,
    CAST(o_orderdate AS DATE) AS journal_date, o_orderdate AS journal_ts, o_orderstatus AS status,
    CASE WHEN o_orderstatus = 'F' THEN 'V' || o_orderkey END AS voucher_id,
    CAST(o_totalprice AS DECIMAL(20,2)) AS amount,
    o_orderdate + to_seconds(o_orderkey % 86400) AS created_date
  FROM orders)"""

AUDIT = """audit AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'JOURNAL_DELETED' WHEN 'signup' THEN 'JOURNAL_CREATED'
      WHEN 'purchase' THEN 'JOURNAL_APPROVED' WHEN 'view' THEN 'JOURNAL_MODIFIED'
      ELSE 'VOUCHER_EXPORTED' END AS event_type,
    ts AS event_timestamp, 'JOURNAL' AS entity_type, json_extract_string(props, '$.k') AS entity_id,
    user_id, 'user' || user_id AS user_name,
    CASE WHEN user_id % 3 = 0 THEN 'SUPERVISOR' ELSE 'CLERK' END AS user_role,
    CASE WHEN user_id % 4 = 0 THEN 'mfa' ELSE 'password' END AS authentication_method,
    '10.0.0.' || (user_id % 8) AS ip_address, CAST(ts AS DATE) AS business_date,
    CAST(CAST(value AS DECIMAL(20,2)) * 10000 AS DECIMAL(20,2)) AS amount,
    CASE WHEN user_id % 2 = 0 THEN 'month end correction' END AS justification
  FROM events)"""

CHECKPOINTS = """checkpoints AS (
  SELECT event_id, user_id % 10 AS worker_id, CAST(value AS DECIMAL(20,2)) AS records_per_second,
    ts AS checkpoint_at, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status
  FROM events)"""
