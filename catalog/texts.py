"""Text projected from the test tables, as SQL expressions that Spark and DuckDB both run."""


def aadhaar_body(key: str) -> str:
    """Eleven digits that start with 2, from a table key."""
    return f"('2' || lpad(cast({key} as string), 10, '0'))"


CUSTOMER_CODES = (
    "'PAN: AB' || chr(cast(65 + c_custkey % 26 as int)) || substr('PCHFATBLJGXZ', cast(1 + c_custkey % 12 as int), 1)"
    " || chr(cast(65 + c_custkey % 25 as int)) || lpad(cast(c_custkey % 10000 as string), 4, '0')"
    " || chr(cast(65 + c_custkey % 24 as int)) || ', IFSC Code: HDFC' || case when c_custkey % 5 = 0 then '1' else '0' end"
    " || lpad(cast(c_custkey % 1000000 as string), 6, '0') || case when c_custkey % 7 = 0 then 'x' else '' end"
)
_A = "cast(60000 + (c_custkey * 37) % 40000 as string)"
_B = "lpad(cast((c_custkey * 7919) % 100000 as string), 5, '0')"
CUSTOMER_PHONE = (
    f"'Mobile: ' || case cast(c_custkey % 6 as int) when 0 then '+91 ' || {_A} || ' ' || {_B} when 1 then '+91-' || {_A} || {_B}"
    f" when 2 then {_A} || {_B} when 3 then '0' || {_A} || {_B} when 4 then '5' || substr({_A}, 2) || {_B}"
    f" else {_A} || {_B} || '7' end || ' office'"
)
_SEGMENT = "substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2))"
CUSTOMER_NAMES = (
    f"case cast(c_custkey % 5 as int) when 0 then 'Dear Ravi ' || {_SEGMENT} || ', thanks.'"
    f" when 1 then 'Employee Name' || repeat(' ', cast(c_custkey % 50 as int)) || ':' || repeat(' ', cast(c_custkey % 60 as int)) || 'Asha ' || {_SEGMENT} || ' | Role: clerk'"
    f" when 2 then 'Dear Customer Care, hello ' || c_name || '.'"
    f" when 3 then 'We met Ravi ' || {_SEGMENT} || ' today'"
    f" else 'Thanks, Mr.' || repeat(' ', cast(1 + c_custkey % 70 as int)) || 'Anil Kumar ' || {_SEGMENT} || ' #' || cast(c_custkey as string) end"
)
SUPPLIER_MAIL = (
    "'Rent is due at the handle s' || cast(s_suppkey as string) || '.x@' || case cast(s_suppkey % 4 as int) when 0 then 'okaxis'"
    " when 1 then 'notabank' when 2 then 'paytm.com' else 'YBL' end"
    " || '; statements reach s' || cast(s_suppkey as string) || '@mail' || cast(s_suppkey % 7 as string) || '.example.com today'"
)
ORDER_ACCOUNT = (
    "case cast(o_orderkey % 4 as int) when 0 then 'Kindly settle into A/c No ' when 1 then 'The parcel code reads '"
    " when 2 then 'The bank wrote last week. Some more words stand here, far from any label, then ' else 'Accountability list ' end"
    " || cast(100000000000 + o_orderkey * 7919 as string) || ' today'"
)
_AMOUNT = "cast(cast(floor(o_totalprice) as bigint) as string)"
ORDER_SALARY = (
    f"case cast(o_orderkey % 4 as int) when 0 then 'Take home salary (INR): ' || {_AMOUNT}"
    f" when 1 then 'From autumn on the salary is ₹' || {_AMOUNT} || ' a month'"
    f" when 2 then 'The bill for the roof comes to INR ' || {_AMOUNT}"
    f" else 'We can go up to a CTC of ' || cast(o_orderkey % 40 + 1 as string) || ' LPA with a desk' end"
)
TURN_HEALTH = (
    "text || case cast((conv_id + turn) % 4 as int) when 0 then ' He lay in bed with jaundice, then appendicitis.'"
    " when 1 then ' Hospitalised after Surgery; blood test pending.' when 2 then ' The hospitality team met.' else '' end"
)
_N = "cast(c_custkey % 9973 as string)"
CUSTOMER_IPV6 = (
    f"'Host ' || case cast(c_custkey % 8 as int) when 0 then '::' || {_N} when 1 then '2001:db8::' when 2 then 'fe80::' || {_N} || ':ab'"
    f" when 3 then '2001:db8:0:1:2:3:4:' || {_N} when 4 then '1:2:3:4::5:6:7:' || {_N} when 5 then '::' || {_N} || ':1:c0:ffee'"
    f" when 6 then 'a::' || {_N} || '::b' else '1:2:3:4:' || {_N} || ':6:7::' end || ' is up'"
)
CUSTOMER_DIALS = (
    f"'Call ' || case cast(c_custkey % 6 as int) when 0 then '+1' || lpad({_N}, 4, '0') when 1 then '+44 20 ' || lpad({_N}, 4, '7')"
    f" when 2 then '+0' || lpad({_N}, 7, '1') when 3 then '+49.30.' || lpad({_N}, 5, '6') when 4 then 'x+1' || lpad({_N}, 5, '2')"
    f" else '+358-9-' || lpad({_N}, 4, '3') end || ' now'"
)
CUSTOMER_CARDS = (
    "'Ref ' || case cast(c_custkey % 7 as int) when 0 then '4' || lpad(cast(c_custkey * 7907 as string), 12, '2')"
    " when 1 then '305' || lpad(cast(c_custkey * 7907 as string), 11, '6') when 2 then '36' || lpad(cast(c_custkey * 7907 as string), 12, '5')"
    " when 3 then '37' || lpad(cast(c_custkey * 7907 as string), 13, '8') when 4 then '5' || lpad(cast(c_custkey * 7907 as string), 15, '1')"
    " when 5 then '6' || lpad(cast(c_custkey * 7907 as string), 18, '2') else '3' || lpad(cast(c_custkey * 7907 as string), 12, '9') end || ' paid'"
)
ORDER_MAIL_DATE = (
    "case cast(o_orderkey % 5 as int) when 0 then '{w}, {d} {m} {y} 16:39:05 -0700 (PDT)' when 1 then '{d} {m} {s} 16:39:05 EST'"
    " when 2 then '{w}, {d} {m} {s} 16:39 PDT' when 3 then '{d} {m} {y} 16:39:05 GMT' else '{w}, {d} {m} {y} 16:39:05 XYZ' end"
)
#: Text that pushes an identifier behind the 200,000th character.
FAR = "repeat('nothing to see here ', 10500)"
