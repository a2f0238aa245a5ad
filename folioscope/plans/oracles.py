"""Oracle SQL on the supplied tables: a shared prefix that reads them as works, and one statement a query."""

from __future__ import annotations

PREFIX = """
WITH RECURSIVE people AS (
  SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS id, s_name, n_name, n_regionkey = 1 AS focal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
linked AS (
  SELECT DISTINCT l_orderkey AS k, id, s_name, focal FROM lineitem JOIN people ON l_suppkey = s_suppkey),
by_order AS (SELECT k, bool_or(focal) AS focal_work, count(*) AS author_count FROM linked GROUP BY k),
works AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS orcid_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS put_code,
    l_orderkey AS k, 'doi:' || l_orderkey AS work_key, '10.1/o' || l_orderkey AS doi, p_name AS title, p_brand AS journal_title,
    CAST(year(l_shipdate) AS INTEGER) AS publication_year, o_orderpriority AS type, p_type AS topic, l_returnflag = 'R' AS is_oa,
    'https://example.org/' || lower(replace(p_brand, '#', '/')) || '.pdf' AS oa_url, n_name AS institution, focal_work, author_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN people ON l_suppkey = s_suppkey JOIN by_order ON l_orderkey = by_order.k),
fw AS (SELECT * FROM works WHERE focal_work),
firsts AS (
  SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1),
collapsed AS (
  SELECT f.work_key, f.k, f.doi, f.title, f.type, f.topic, f.journal_title AS first_journal, g.*
  FROM firsts f JOIN (SELECT work_key AS wk, max(publication_year) AS publication_year, max(journal_title) AS journal_title, max(oa_url) AS oa_url,
    bool_or(is_oa) AS is_oa, true AS oa_checked FROM fw GROUP BY work_key) g ON f.work_key = g.wk)
"""

AUTHOR = """,
mine AS (SELECT * FROM collapsed WHERE k IN (SELECT k FROM linked WHERE id = '{ident}'))
"""

NETWORK = """,
net AS (SELECT * FROM fw WHERE publication_year BETWEEN {start} AND {end} AND type = '{kind}' AND topic = '{topic}'),
rel AS (SELECT DISTINCT s.work_key, l.id AS orcid_id FROM net s JOIN linked l ON s.k = l.k),
pairs AS (SELECT a.work_key, a.orcid_id AS source, b.orcid_id AS target FROM rel a JOIN rel b ON a.work_key = b.work_key AND a.orcid_id < b.orcid_id),
edges AS (SELECT source, target, count(*) AS weight FROM pairs GROUP BY ALL),
nodes AS (SELECT orcid_id, count(*) AS publications FROM rel GROUP BY ALL)
"""

COMPONENT = """,
reach AS (SELECT '{seed}' AS id WHERE EXISTS (SELECT 1 FROM rel WHERE orcid_id = '{seed}')
  UNION SELECT CASE WHEN e.source = r.id THEN e.target ELSE e.source END FROM reach r JOIN edges e ON e.source = r.id OR e.target = r.id),
own AS (SELECT * FROM rel WHERE orcid_id IN (SELECT id FROM reach)),
many AS (SELECT work_key FROM own GROUP BY work_key HAVING count(*) > 1),
common AS (SELECT * FROM own WHERE work_key IN (SELECT work_key FROM many)),
years AS (SELECT work_key, publication_year AS year FROM net WHERE publication_year <> 0
  QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY orcid_id, put_code) = 1)
"""


def sql(body: str, *parts: str, **values) -> str:
    return PREFIX + "".join(p.format(**values) for p in parts) + body.format(**values)
