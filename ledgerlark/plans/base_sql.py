"""The catalogue's views in DuckDB SQL, as common table expressions that the oracle statements start with."""

from ..functions.text import STOP_WORDS

SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) <= 5 THEN 'Spring' WHEN month({0}) <= 8 THEN 'Summer' ELSE 'Fall' END"

BASE = f"""
WITH RECURSIVE listing0 AS (
  SELECT o_orderkey AS id, o_custkey AS course_id, CAST(o_orderdate AS DATE) AS starts_on, year(o_orderdate) AS term_year, {SEASON.format('o_orderdate')} AS term_season,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 20 AS INTEGER) END AS registration_deadline,
    CASE o_orderkey % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS is_evening,
    CASE o_orderkey % 5 WHEN 0 THEN 'in_person' WHEN 1 THEN 'online_sync' WHEN 2 THEN 'online_async' WHEN 3 THEN 'hybrid' ELSE 'unknown' END AS delivery_mode,
    CASE o_orderkey % 6 WHEN 0 THEN 'New Brunswick' WHEN 1 THEN 'Newark' WHEN 2 THEN 'Camden' WHEN 3 THEN 'Online' WHEN 4 THEN 'Other' ELSE 'unknown' END AS campus,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'full' ELSE 'waitlist' END AS status,
    CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS total_fee_cents, o_orderkey % 7 = 0 AS is_gone
  FROM orders
), listing AS (
  SELECT *, term_season || ' ' || term_year AS term, term_year * 10 + CASE term_season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 ELSE 4 END AS term_rank FROM listing0
), course AS (
  SELECT c_custkey AS id, c_nationkey AS unit_id, c_name AS course_title, c_mktsegment AS program, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 60 AS DOUBLE) END AS contact_hours FROM customer
), unit AS (
  SELECT n_nationkey AS id, n_name AS name, r_name AS campus_name FROM nation JOIN region ON n_regionkey = r_regionkey
), listing_view AS (
  SELECT l.*, c.course_title, c.program, c.contact_hours, u.name AS unit_name FROM listing l JOIN course c ON l.course_id = c.id LEFT JOIN unit u ON c.unit_id = u.id
), listing_fee AS (
  SELECT l_orderkey AS listing_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ord,
    'Part ' || l_partkey AS label, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amount_cents FROM lineitem
), message AS (
  SELECT conv_id AS session_id, turn AS id, role, text AS prose FROM conversations
)
"""

def words(column: str) -> str:
    """SQL for the words of lexical search: lower-cased letters and digits, without stop words."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda w: w NOT IN ({stop}))"
