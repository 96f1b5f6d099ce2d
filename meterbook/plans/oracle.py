"""DuckDB side of the correctness check.

``VIEWS`` derives the book tables from the driver's raw tables in DuckDB SQL
(the same derivations ``meterbook.sources.fixtures.Book`` writes with the
DataFrame API). ``with_views(sql)`` prefixes a query with exactly the views
it references, in dependency order, so each oracle stands alone.
"""

from __future__ import annotations

import re

import datetime as _dt

from ..sources.fixtures import AS_OF, CALLBACK_SECRET, hmac_pads

YESTERDAY = str(_dt.date.fromisoformat(AS_OF) - _dt.timedelta(days=1))


def render_sql(template: str, fields: dict[str, str]) -> str:
    """A message template as a SQL string concatenation over ``fields``."""
    from ..functions.exprs import template_parts
    out = []
    for kind, value in template_parts(template):
        out.append("(" + fields[value] + ")" if kind == "field" else "'" + value.replace("'", "''") + "'")
    return " || ".join(out)


def duck_hmac(msg_sql: str, secret: str = CALLBACK_SECRET) -> str:
    ipad, opad = hmac_pads(secret)
    return (f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({msg_sql}))))")


VIEWS: dict[str, str] = {}

VIEWS["plans"] = """SELECT * FROM (VALUES
 (1,'Starter Fiber','30 Mbps',CAST(399 AS DECIMAL(10,2)),30),
 (2,'Basic Plan','50 Mbps',CAST(499 AS DECIMAL(10,2)),30),
 (3,'Turbo Fiber','150 Mbps',CAST(799 AS DECIMAL(10,2)),30),
 (4,'Family Fiber','500 Mbps',CAST(1499 AS DECIMAL(10,2)),30),
 (5,'Giga Fiber','1 Gbps',CAST(1999 AS DECIMAL(10,2)),30)) t(id,name,speed,price,validity)"""

VIEWS["customers"] = """SELECT c_custkey AS id, c_name AS name,
 lower(replace(c_name,'#','.'))||'@example.com' AS email,
 CASE c_custkey%4 WHEN 0 THEN '9'||lpad(CAST(c_custkey AS STRING),9,'0')
                  WHEN 1 THEN '+91 9'||lpad(CAST(c_custkey AS STRING),9,'0')
                  WHEN 2 THEN '12345' END AS phone,
 nullif(c_nationkey%6,0) AS plan_id,
 'addr '||CAST(c_custkey AS STRING) AS address,
 CASE c_custkey%10 WHEN 0 THEN 'pending' WHEN 1 THEN 'suspended' ELSE 'active' END AS status
FROM customer"""

VIEWS["users"] = """SELECT s_suppkey+1 AS id, s_name AS name, lower(replace(s_name,'#','.'))||'@example.com' AS email,
 CASE WHEN s_suppkey=0 THEN 'admin' ELSE 'staff' END AS role FROM supplier
UNION ALL
SELECT 1000000+id AS id, name, email, 'customer' AS role FROM customers WHERE id%20<>19"""

VIEWS["bills"] = """SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
 CASE WHEN o_orderstatus='F' THEN 'paid' ELSE 'unpaid' END AS status,
 CAST(o_orderdate AS DATE) AS bill_date, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS due_date
FROM orders"""

VIEWS["bill_items"] = """SELECT CAST(l_linenumber AS BIGINT)*1000000000+l_partkey*10000+l_suppkey AS id,
 l_orderkey AS bill_id, p_name AS description, CAST(l_extendedprice AS DECIMAL(10,2)) AS amount,
 CASE WHEN l_linenumber=1 THEN 'subscription' ELSE 'hardware' END AS item_type
FROM lineitem JOIN part ON l_partkey=p_partkey"""

VIEWS["payments"] = """SELECT b.id*2+k AS id, b.id AS bill_id, b.customer_id, b.amount, 'paid' AS status,
 CASE WHEN k=0 THEN 'manual' ELSE 'online' END AS method,
 CASE WHEN k=0 THEN 'staff' ELSE 'razorpay' END AS provider,
 CASE WHEN k=1 THEN 'order_'||CAST(b.id AS STRING) END AS provider_order_id,
 CASE WHEN k=1 THEN 'pay_'||CAST(b.id AS STRING) END AS provider_payment_id,
 'NW-'||CAST(b.id AS STRING)||'-'||CAST(k AS STRING) AS receipt_number,
 CAST(b.bill_date AS TIMESTAMP) + INTERVAL 30 HOUR AS paid_at
FROM bills b CROSS JOIN (VALUES (0),(1)) t(k)
WHERE b.status='paid' AND (k=0 OR b.id%5=0)"""

VIEWS["bill_reminders"] = f"""SELECT id, id AS bill_id, DATE '{AS_OF}' AS reminder_date, 'due' AS reminder_type
FROM bills WHERE status<>'paid' AND id%7=0
UNION ALL
SELECT -id AS id, id AS bill_id, DATE '{YESTERDAY}' AS reminder_date, 'due' AS reminder_type
FROM bills WHERE status<>'paid' AND id%7=1"""

VIEWS["data_usage"] = """SELECT user_id AS customer_id, CAST(ts AS DATE) AS usage_date,
 CAST(sum(CAST(value AS DECIMAL(10,2))) AS DECIMAL(10,2)) AS used_gb,
 CAST(CASE WHEN user_id%10=0 THEN 0 WHEN user_id%10=1 THEN 50 ELSE 1000 END AS DECIMAL(10,2)) AS total_gb
FROM events WHERE event_type<>'error' GROUP BY user_id, CAST(ts AS DATE)"""

VIEWS["support_tickets"] = """SELECT event_id AS id, CASE WHEN event_id%6=0 THEN NULL ELSE user_id END AS customer_id,
 c.name, CASE WHEN event_id%7=0 THEN NULL ELSE c.email END AS email, 'issue '||props AS issue,
 CASE event_id%3 WHEN 0 THEN 'open' WHEN 1 THEN 'in-progress' ELSE 'resolved' END AS status,
 ts AS created_at
FROM events JOIN customers c ON c.id=user_id WHERE event_type='error'"""

VIEWS["notification_logs"] = """SELECT event_id AS id, CASE WHEN event_id%9=0 THEN NULL ELSE event_id%1500 END AS bill_id,
 CASE WHEN event_id%8=0 THEN NULL ELSE user_id END AS customer_id,
 CASE event_id%3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'sms' ELSE 'email' END AS channel,
 CASE WHEN event_id%2=0 THEN 'due' ELSE 'paid' END AS notification_type,
 CASE event_id%5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'sent' END AS status,
 props AS message, ts AS created_at
FROM events"""

VIEWS["access_log"] = """SELECT event_id AS request_id, CASE WHEN user_id%3=0 THEN 0 ELSE user_id END AS client_key,
 make_timestamp(1704067200000000 + us) AS ts,
 CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'signup' THEN 'login' ELSE 'api' END AS route_class,
 (us + CASE WHEN event_id%40=7 THEN 1800000000 ELSE 0 END) // 1800000000 AS landing
FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 720 AS us FROM events)"""

VIEWS["charge_requests"] = """SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS request_id,
 CASE WHEN l_partkey%19=0 THEN -l_orderkey-1 ELSE l_orderkey END AS bill_id,
 CASE WHEN l_partkey%17=0 THEN '  ' ELSE ' '||p_name||' ' END AS description,
 CAST(CASE WHEN l_partkey%13=0 THEN 0 ELSE l_quantity*10 END AS DECIMAL(10,2)) AS amount,
 CASE WHEN l_partkey%3=0 THEN NULL WHEN l_partkey%3=1 THEN ' Service ' ELSE 'hardware' END AS item_type
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity
      FROM lineitem GROUP BY l_orderkey, l_linenumber) x
JOIN part ON l_partkey=p_partkey
UNION ALL
SELECT id*10+9 AS request_id, CASE WHEN id%5=0 THEN -id-1 ELSE id END AS bill_id, 'Router' AS description,
 CAST(50 AS DECIMAL(10,2)) AS amount, 'hardware' AS item_type
FROM bills WHERE NOT EXISTS (SELECT 1 FROM bill_items i WHERE i.bill_id=bills.id)"""

VIEWS["raw_items"] = """SELECT CASE WHEN request_id%101=3 THEN '#'||CAST(request_id AS STRING) ELSE CAST(request_id AS STRING) END AS id,
 CASE WHEN request_id%23=4 THEN NULL WHEN request_id%29=5 THEN 'none' ELSE CAST(bill_id AS STRING) END AS bill_id,
 nullif(trim(description),'') AS description,
 CASE WHEN request_id%13=6 THEN 'n/a' WHEN request_id%17=7 THEN '123456789.00' ELSE CAST(amount AS STRING) END AS amount,
 item_type,
 CASE WHEN request_id%7=1 THEN 'soon' WHEN request_id%7<5
   THEN strftime(TIMESTAMP '1998-06-01 00:00:00' + to_hours(request_id%300), '%Y-%m-%d %H:%M:%S') END AS created_at
FROM charge_requests"""

VIEWS["customer_patches"] = """SELECT CASE x WHEN 0 THEN rid WHEN 1 THEN rid+1 ELSE rid+2 END AS request_id,
 CASE WHEN x=2 THEN -id-1 ELSE id END AS id, CASE WHEN id%2=0 THEN name||' Jr' END AS name,
 CASE id%10 WHEN 0 THEN 'NEW.'||email WHEN 1 THEN ' customer.'||lpad(CAST(id+1 AS STRING),9,'0')||'@EXAMPLE.com'
   WHEN 2 THEN 'moved.'||email WHEN 3 THEN 'supplier.'||lpad(CAST(id%10+1 AS STRING),9,'0')||'@example.com'
   WHEN 4 THEN 'shared@example.com' WHEN 5 THEN upper(email) END AS email,
 CASE WHEN id%3=0 THEN '' WHEN id%17=1 THEN '123' WHEN id%17=2 THEN '98765 43210' END AS phone,
 CASE WHEN id%19=0 THEN '' WHEN id%19=1 THEN 'moved street' END AS address,
 CASE WHEN id%13=0 THEN 77 WHEN id%4=0 THEN 3 END AS plan_id,
 CASE WHEN id%11=0 THEN 'bogus' WHEN id%7=0 THEN 'suspended' END AS status
FROM (SELECT *, CASE WHEN id%20<10 THEN id ELSE 2000000000-id END * 10 + 7 AS rid FROM customers) c
CROSS JOIN (VALUES (0),(1),(2)) t(x) WHERE x=0 OR (x=1 AND id%50=1) OR (x=2 AND id%100=3)"""

VIEWS["registrations"] = """SELECT id AS request_id, CASE WHEN id%24=5 THEN '  ' ELSE ' '||name||' ' END AS name,
 CASE WHEN id%4=0 THEN upper(email) WHEN id%20=18 THEN 'customer.'||lpad(CAST(id+1 AS STRING),9,'0')||'@example.com'
      WHEN id%40=11 THEN 'no-address' ELSE 'reg.'||CAST(id%400 AS STRING)||'@example.com' END AS email,
 CASE WHEN id%10=9 THEN '12345' ELSE '+91-98765'||lpad(CAST(id%100000 AS STRING),5,'0') END AS phone,
 CASE WHEN id%12=5 THEN ' ' ELSE 'street '||CAST(id AS STRING) END AS address,
 CASE WHEN id%50=13 THEN NULL WHEN id%8=7 THEN 99 ELSE id%5+1 END AS plan_id
FROM customers"""

VIEWS["payment_callbacks"] = f"""SELECT id*2+k AS callback_id,
 CASE WHEN id%13=0 THEN -id-1 WHEN id%29=3 THEN NULL ELSE id END AS bill_id,
 CASE WHEN id%31<>5 THEN 'order_'||CAST(id AS STRING) END AS order_id,
 CASE WHEN id%37=7 THEN ' ' ELSE 'pay_'||CAST(id AS STRING) END AS payment_id,
 CASE WHEN id%11=0 THEN 'bad' WHEN id%17=0 THEN NULL
      ELSE {duck_hmac("'order_'||CAST(id AS STRING)||'|'||'pay_'||CAST(id AS STRING)")} END AS signature,
 CASE WHEN k=0 THEN CAST(bill_date AS TIMESTAMP) + INTERVAL 1 HOUR
      ELSE CAST(bill_date AS TIMESTAMP) + INTERVAL 2 HOUR END AS received_at
FROM bills CROSS JOIN (VALUES (0),(1)) t(k) WHERE k=0 OR id%4=0"""

VIEWS["principals"] = """SELECT id, CASE WHEN id%7=0 THEN NULL WHEN id%4=0 THEN upper(email) ELSE email END AS email,
 name, role FROM users
UNION ALL
SELECT 1000000+id AS id, CAST(NULL AS STRING) AS email, name, 'customer' AS role FROM customers WHERE id%20=19"""

VIEWS["login_requests"] = """SELECT id AS request_id,
 CASE WHEN id%3=0 THEN ' '||upper(email)||' ' ELSE email END AS email,
 CASE WHEN id%5=0 THEN 'staff' WHEN id%5=1 THEN ' Customer ' WHEN id%5=2 THEN NULL ELSE role END AS role
FROM users"""

VIEWS["approve_requests"] = """SELECT id*10 AS request_id, CASE WHEN id%40=0 THEN -id-1 ELSE id END AS customer_id
FROM customers WHERE id%4=0"""

VIEWS["billing_requests"] = """SELECT id*10+4 AS request_id,
 CASE id%50 WHEN 0 THEN -id-1 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE id END AS customer_id
FROM customers"""

VIEWS["settle_requests"] = """SELECT id*10+3 AS request_id, CASE WHEN id%55=0 THEN -id-1 ELSE id END AS bill_id FROM bills"""

VIEWS["reject_requests"] = """SELECT id*10+1 AS request_id, CASE WHEN id%42=0 THEN -id-1 ELSE id END AS customer_id
FROM customers WHERE id%6=0"""

VIEWS["delete_requests"] = """SELECT id*10+2 AS request_id, CASE WHEN id%70=0 THEN -id-1 ELSE id END AS customer_id
FROM customers WHERE id%7=0"""

VIEWS["plan_requests"] = """SELECT p_partkey AS request_id,
 CASE WHEN p_partkey%100=0 THEN CAST(p_partkey%7+1 AS INTEGER) END AS id,
 CASE WHEN p_partkey%450=0 THEN ' ' ELSE ' '||p_brand||' ' END AS name,
 CASE WHEN p_partkey%350=0 THEN '' ELSE CAST(p_size AS STRING)||' Mbps' END AS speed,
 CASE p_partkey%9 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN 'NaN'
      ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END AS price,
 CASE WHEN p_partkey%8=0 THEN '0' ELSE '30' END AS validity
FROM part WHERE p_partkey%50=0"""

VIEWS["plan_delete_requests"] = """SELECT p_partkey AS request_id, CAST(p_partkey%7+1 AS INTEGER) AS plan_id
FROM part WHERE p_partkey%100=3"""

VIEWS["staff_requests"] = """SELECT s_suppkey AS request_id,
 CASE WHEN s_suppkey%9=0 THEN '' ELSE ' '||s_name||' ' END AS name,
 CASE WHEN s_suppkey%5=0 THEN upper(lower(replace(s_name,'#','.'))||'@example.com')
      WHEN s_suppkey%5=1 THEN 'team'||CAST(s_suppkey%10 AS STRING)||'@example.com'
      ELSE 'new.staff'||CAST(s_suppkey AS STRING)||'@example.com' END AS email,
 CASE WHEN s_suppkey%13=0 THEN 0 WHEN s_suppkey%11=0 THEN 4 ELSE 10 END AS password_length
FROM supplier"""

VIEWS["staff_delete_requests"] = """SELECT id AS request_id, id AS user_id FROM users WHERE id%3=0"""

VIEWS["ticket_requests"] = """SELECT e.event_id AS request_id, 1000000+e.user_id AS principal_id, c.name, c.email,
 CASE WHEN e.event_id%10=0 THEN '  ' ELSE ' '||e.props||' ' END AS issue, e.ts AS requested_at
FROM events e LEFT JOIN customers c ON c.id=e.user_id WHERE e.event_type='signup'"""

VIEWS["ticket_moves"] = """SELECT id*10 AS request_id, CASE WHEN id%36=0 THEN -id-1 ELSE id END AS ticket_id,
 CASE WHEN id%28=0 THEN NULL ELSE CASE id%5 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' WHEN 2 THEN 'in-progress' ELSE 'resolved' END END AS status
FROM support_tickets"""

VIEWS["usage_reports"] = """SELECT event_id AS report_id, user_id AS customer_id, CAST(ts AS DATE) AS usage_date,
 CAST(value AS DECIMAL(10,2)) AS used_gb,
 CAST(CASE WHEN event_id%2=0 THEN 500 ELSE 1000 END AS DECIMAL(10,2)) AS total_gb, ts AS reported_at
FROM events WHERE event_type IN ('purchase','error')"""

VIEWS["profile_patches"] = """SELECT id*10+5 AS request_id,
 CASE WHEN id%39=0 THEN 'nobody'||CAST(id AS STRING)||'@example.com' WHEN id%2=0 THEN upper(email) ELSE email END AS email,
 CASE WHEN id%3=0 THEN '' ELSE name||' X' END AS name,
 CASE id%4 WHEN 0 THEN '98765 43210' WHEN 1 THEN '123' WHEN 2 THEN '' END AS phone,
 CASE WHEN id%5=0 THEN ' new addr ' END AS address
FROM customers"""

VIEWS["customer_requests"] = """SELECT id*10+6 AS request_id, CASE WHEN id%23=0 THEN ' ' ELSE ' '||name||' ' END AS name,
 CASE WHEN id%10=0 THEN email WHEN id%20=13 THEN 'supplier.'||lpad(CAST(id%60+1 AS STRING),9,'0')||'@example.com'
      WHEN id%50=7 THEN 'Desk@example.com' ELSE 'new.'||email END AS email,
 CASE WHEN id%4=0 THEN '98765'||lpad(CAST(id%100000 AS STRING),5,'0') WHEN id%16=1 THEN '555'
      ELSE '+91 98765 '||lpad(CAST(id%100000 AS STRING),5,'0') END AS phone,
 'addr '||CAST(id AS STRING) AS address,
 CASE WHEN id%15=0 THEN 42 ELSE plan_id END AS plan_id,
 CASE WHEN id%2=0 OR id%20=13 THEN 8 WHEN id%3=0 THEN 3 ELSE 0 END AS password_length
FROM customers"""

VIEWS["notify_requests"] = """SELECT id AS request_id, CASE WHEN id%85=0 THEN -id-1 ELSE id END AS bill_id,
 CASE id%5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'due' WHEN 3 THEN 'PAID' ELSE 'bogus' END AS notification_type
FROM bills"""

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()


def _refs(sql: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", sql)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every view it (transitively) uses."""
    need: set[str] = set()
    todo = list(_refs(sql))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(_refs(VIEWS[n]) - {n})
    ordered = [n for n in VIEWS if n in need]
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered)
    body = sql.lstrip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
