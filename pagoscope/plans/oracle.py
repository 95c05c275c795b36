"""DuckDB SQL for the registered queries, written from the operator definitions.

The texts share common table expressions: ``payments`` (the derived table),
``norm`` (parsed columns), ``codes`` (quality codes), ``f`` (findings), ``s``
(scores) and ``adv`` (advice). ``g`` is the grouping key: a constant for the
whole table, the source system, or a segment.
"""

from __future__ import annotations

from pagoscope.plans import oracle_values as fv
from pagoscope.sources.layout import PAYMENT_COLUMNS

ORACLE: dict[str, str] = {}


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _value(v) -> str:
    if v is None:
        return "NULL"
    return _quoted([v]) if isinstance(v, str) else repr(v)


def _values(name: str, rows, *columns: str) -> str:
    body = ", ".join("(" + ", ".join(map(_value, row)) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


_TIME = "'%Y-%m-%d %H:%M:%S'"
PAYMENTS = f"""
payments AS (
  SELECT k AS row_id,
    CASE WHEN k%211=0 THEN NULL WHEN k%223=5 THEN '   '
         WHEN k%97=2 THEN 'PAY-'||lpad(cast(k-1 AS varchar),8,'0')
         ELSE 'PAY-'||lpad(cast(k AS varchar),8,'0') END AS payment_id,
    CASE WHEN k%61=3 THEN NULL ELSE c_name END AS customer_name,
    CASE WHEN k%122=3 OR k%31=4 THEN NULL WHEN k%37=5 THEN 'not-an-email'
         WHEN k%41=6 THEN 'missing@'
         ELSE lower(replace(c_name,'#','.'))||'@bank.example' END AS customer_email,
    CASE WHEN k%53=7 THEN NULL WHEN k%103=10 THEN '   ' WHEN k%101=9 THEN 'N/D'
         WHEN k%59=8 THEN '-'||cast(cast(floor(o_totalprice) AS bigint)%5000+1 AS varchar)
         WHEN k%107=11 THEN cast(999000+(k%3)*600000 AS varchar)
         WHEN o_custkey%10=0 AND k%3=0 THEN cast(9000+k%1000 AS varchar)
         ELSE cast(cast(floor(o_totalprice) AS bigint)%45000 AS varchar) END AS amount,
    CASE WHEN k%20<10 THEN 'USD' WHEN k%20<14 THEN 'EUR' WHEN k%20<16 THEN 'COP'
         WHEN k%20=16 THEN 'GBP' WHEN k%20=17 THEN 'MXN' WHEN k%40=18 THEN 'XXX'
         WHEN k%40=38 THEN NULL WHEN k%60=19 THEN 'IRR' WHEN k%60=39 THEN 'JPY'
         ELSE 'usd' END AS currency_code,
    CASE WHEN k%43=0 THEN NULL WHEN k%47=1 THEN 'UNKNOWN' WHEN k%71=2 THEN 'ON_HOLD'
         WHEN k%73=3 THEN ' completed ' WHEN o_orderstatus='F' THEN 'COMPLETED'
         WHEN o_orderstatus='O' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
    CASE c_nationkey WHEN 0 THEN 'US' WHEN 1 THEN 'CO' WHEN 2 THEN 'MX' WHEN 3 THEN 'ES'
         WHEN 4 THEN 'GB' WHEN 5 THEN 'DE' WHEN 6 THEN 'FR' WHEN 7 THEN 'BR'
         WHEN 8 THEN 'AR' WHEN 9 THEN 'CL' WHEN 10 THEN 'PE' WHEN 11 THEN 'IR'
         WHEN 12 THEN 'VE' WHEN 13 THEN 'ZZ' WHEN 14 THEN NULL WHEN 15 THEN 'co' WHEN 16 THEN 'SD'
         ELSE 'US' END AS country_code,
    CASE WHEN k%67=1 THEN NULL WHEN k%79=2 THEN '2999-01-01 00:00:00'
         WHEN k%83=3 THEN 'not-a-date'
         WHEN k%101=4 THEN 'T12:30:00'
         WHEN k%103=5 THEN strftime(o_orderdate,'%Y/%m/%d %H:%M:%S')
         WHEN k%107=6 THEN strftime(o_orderdate,'%d-%m-%Y %H:%M:%S')
         ELSE strftime(o_orderdate,{_TIME}) END AS created_at,
    CASE WHEN k%113=1 THEN NULL
         WHEN k%89=4 THEN strftime(o_orderdate - INTERVAL 1 DAY,{_TIME})
         ELSE strftime(o_orderdate,{_TIME}) END AS updated_at,
    CASE WHEN k%91=0 THEN NULL WHEN k%5=0 THEN 'CORE_BANKING' WHEN k%5=1 THEN 'SWIFT'
         WHEN k%5=2 THEN 'ACH' WHEN k%5=3 THEN 'SEPA' ELSE 'LEGACY_COBOL' END
      AS source_system,
    CASE WHEN c_nationkey IN (11,12) THEN '1' ELSE '0' END AS sanction_flag_expected,
    {", ".join(f"cast(NULL AS varchar) AS {c}" for c in PAYMENT_COLUMNS[11:])}
  FROM (SELECT *, o_orderkey AS k FROM orders) JOIN customer ON o_custkey = c_custkey
)"""

_NUMBER = (
    r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])"
)
_PAIRS = [(c, m) for c, allowed in fv.COUNTRY_CURRENCIES.items() for m in allowed]


def base(g: str = "'all'") -> str:
    """payments, norm and codes; quality codes keep the registry's order."""
    return f"""WITH {PAYMENTS},
norm AS (
  SELECT *, {g} AS g,
    CASE WHEN regexp_full_match(trim(amount), '{_NUMBER}')
         THEN try_cast(trim(amount) AS double) END AS num,
    try_strptime(created_at,[{_TIME},'%Y/%m/%d %H:%M:%S','%d-%m-%Y %H:%M:%S']) AS cts, try_strptime(updated_at,{_TIME}) AS uts,
    upper(trim(status)) AS su, upper(trim(currency_code)) AS cu,
    trim(country_code) AS ct, trim(customer_email) AS em,
    coalesce(trim(payment_id),'')='' AS id_blank, coalesce(trim(amount),'')='' AS amt_blank,
    coalesce(trim(status),'')='' AS st_blank, coalesce(trim(currency_code),'')='' AS cur_blank,
    coalesce(trim(country_code),'')='' AS ctry_blank,
    coalesce(trim(customer_email),'')='' AS em_blank,
    coalesce(trim(customer_name),'')='' AS name_blank,
    coalesce(trim(created_at),'')='' AS cr_blank, coalesce(trim(updated_at),'')='' AS up_blank,
    coalesce(trim(source_system),'')='' AS src_blank
  FROM payments),
amt AS (SELECT *, CASE WHEN NOT isnan(num) THEN num END AS val FROM norm),
{_values("pairs", _PAIRS, "country", "currency")},
codes AS (
  SELECT *,
    CASE WHEN id_blank THEN 'payment_id_nulo' END AS c1,
    CASE WHEN amt_blank THEN 'amount_nulo' END AS c2,
    CASE WHEN amount IS NOT NULL AND num IS NULL THEN 'amount_no_numerico'
         WHEN num < 0 THEN 'amount_negativo' END AS c3,
    CASE WHEN val > {fv.AMOUNT_LIMIT} THEN 'amount_supera_limite' END AS c4,
    CASE WHEN su='COMPLETED' AND amt_blank THEN 'completado_sin_monto' END AS c5,
    CASE WHEN st_blank THEN 'status_nulo_legacy' WHEN su='UNKNOWN' THEN 'status_unknown_legacy'
         WHEN su NOT IN ({_quoted(fv.STATUSES)}) THEN 'status_no_reconocido:'||su END AS c6,
    CASE WHEN cur_blank THEN 'currency_nulo_legacy'
         WHEN cu IN ('XXX','NAN') THEN 'currency_sin_valor_iso'
         WHEN cu NOT IN ({_quoted(fv.CURRENCIES)})
           THEN 'currency_no_habilitada:'||cu END AS c7,
    CASE WHEN ctry_blank THEN 'country_nulo'
         WHEN upper(ct) NOT IN ({_quoted(fv.COUNTRIES)})
           THEN 'country_desconocido:'||ct END AS c8,
    CASE WHEN em_blank THEN 'customer_email_nulo' END AS c9,
    CASE WHEN NOT em_blank AND NOT regexp_full_match(em,'[^@\\s]+@[^@\\s]+\\.[^@\\s]+')
         THEN 'email_formato_invalido' END AS c10,
    CASE WHEN cr_blank THEN 'created_at_nulo' WHEN cts IS NULL
         THEN 'created_at_formato_invalido'
         WHEN cts > TIMESTAMP '2026-01-01 00:00:00' THEN 'created_at_futura' END AS c11,
    CASE WHEN uts < cts THEN 'updated_at_menor_que_created_at' END AS c12,
    CASE WHEN upper(ct) IN (SELECT country FROM pairs)
          AND coalesce(cu,'NAN') NOT IN ('','USD')
          AND upper(ct)||'/'||coalesce(cu,'NAN')
              NOT IN (SELECT country||'/'||currency FROM pairs)
         THEN 'moneda_'||coalesce(cu,'NAN')||'_no_esperada_para_'||upper(ct) END AS c13,
    CASE WHEN src_blank THEN 'source_system_nulo' END AS c14
  FROM amt),
ev AS (
  SELECT *, coalesce(c1,c2,c3,c4) IS NOT NULL AS is_error,
    coalesce(c5,c6,c7,c8,c9,c10,c11,c12,c13,c14) IS NOT NULL AS is_warning,
    concat_ws(' | ',c1,c2,c3,c4) AS critical,
    concat_ws(' | ',c5,c6,c7,c8,c9,c10,c11,c12,c13,c14) AS warning,
    concat_ws(' | ','[C]'||c1,'[C]'||c2,'[C]'||c3,'[C]'||c4,'[W]'||c5,'[W]'||c6,'[W]'||c7,
      '[W]'||c8,'[W]'||c9,'[W]'||c10,'[W]'||c11,'[W]'||c12,'[W]'||c13,'[W]'||c14) AS all_codes
  FROM codes),
issue AS (
  SELECT g, split_part(code,':',1) AS family FROM (
    SELECT g, unnest([c1,c2,c3,c4,c5,c6,c7,c8,c9,c10,c11,c12,c13,c14]) AS code FROM codes)
  WHERE code IS NOT NULL),
fam AS (SELECT g, family, count(*) AS n FROM issue GROUP BY g, family),
q AS (
  SELECT t.*, coalesce(x.failed,0) AS failed, coalesce(x.issues,0) AS issues FROM (
    SELECT g, count(*) AS total, count(*) FILTER (is_error) AS err,
      count(*) FILTER (is_warning) AS warn FROM ev GROUP BY g) t
  LEFT JOIN (SELECT g, count(*) AS failed, cast(sum(n) AS bigint) AS issues FROM fam
             GROUP BY g) x ON t.g IS NOT DISTINCT FROM x.g),
dq AS (
  SELECT *, cast(greatest(0, least(100, round_even(
    (cast(total-err AS double)/total)*100 - failed*0.3::double, 0))) AS integer) AS dq
  FROM q)"""


def _finding_rows() -> str:
    """Findings as rows (seq, rule, framework, severity, record, detail, area, affected)."""
    pid = "coalesce(payment_id,'N/A')"

    def row(seq, rule, frameworks, severity, area, where, record, detail):
        return (
            f"SELECT g, {seq} AS rule_seq, '{rule}' AS rule, '{frameworks}' AS framework,"
            f" '{severity}' AS severity, {record} AS record, {detail} AS detail,"
            f" '{area}' AS risk_area, cast(NULL AS bigint) AS affected_records"
            f" FROM amt WHERE {where}"
        )

    def group(seq, rule, frameworks, severity, area, key, where, minimum, detail):
        return (
            f"SELECT g, {seq}, '{rule}', '{frameworks}', '{severity}', {key}, {detail},"
            f" '{area}', count(*) FROM amt WHERE {where} GROUP BY g, {key}"
            f" HAVING count(*) >= {minimum}"
        )

    def table(seq, rule, frameworks, severity, area, where, detail):
        return (
            f"SELECT g, {seq}, '{rule}', '{frameworks}', '{severity}', 'dataset-level',"
            f" {detail}, '{area}', count(*) FROM amt WHERE {where} GROUP BY g"
        )

    def system(seq, rule, frameworks, severity, detail):
        return (
            f"SELECT DISTINCT g, {seq}, '{rule}', '{frameworks}', '{severity}',"
            f" 'system-level', '{detail}', 'operational_resilience', cast(NULL AS bigint)"
            f" FROM amt"
        )

    parts = [
        row(1, "MISSING_PAYMENT_ID", "SOX, PCI-DSS", "CRITICAL", "traceability", "id_blank",
            "cast(row_id AS varchar)", "'payment_id nulo — transacción no auditable'"),
        row(2, "INVALID_AMOUNT", "SOX, PCI-DSS", "CRITICAL", "financial_integrity",
            "val IS NULL OR val < 0", pid,
            "'amount='''||coalesce(amount,'null')||''' — integridad financiera comprometida'"),
        group(3, "DUPLICATE_PAYMENT_ID", "PCI-DSS, SOX, Basel III", "CRITICAL",
              "financial_integrity", "payment_id", "payment_id IS NOT NULL", 2,
              "'payment_id '''||payment_id||''' aparece '||count(*)"
              "||' veces — riesgo de doble cargo'"),
        row(4, "OFAC_SANCTIONED_COUNTRY", "OFAC, AML, PCI-DSS", "CRITICAL",
            "sanctions_compliance", f"country_code IN ({_quoted(fv.SANCTIONED_COUNTRIES)})",
            pid, "'Transacción con país sancionado '''||country_code||''' — violación OFAC'"),
        row(5, "OFAC_SANCTIONED_CURRENCY", "OFAC, AML", "CRITICAL", "sanctions_compliance",
            f"currency_code IN ({_quoted(fv.SANCTIONED_CURRENCIES)})", pid,
            "'Moneda sancionada '''||currency_code||''' — violación OFAC'"),
        group(6, "AML_STRUCTURING_PATTERN", "AML, FinCEN, Basel III", "CRITICAL",
              "aml_compliance", "customer_name",
              "customer_name IS NOT NULL AND val BETWEEN 9000 AND 9999", 3,
              "''''||customer_name||''' tiene '||count(*)||' transacciones entre"
              " $9,000–$9,999 — patrón de structuring AML'"),
        *[
            table(7, "PLAINTEXT_PII_FIELD", "GDPR, PCI-DSS, DORA", "HIGH", "encryption",
                  f"NOT {flag}", f"'Campo ''{field}'' contiene '||count(*)||"
                  "' valores PII en texto plano — cifrado requerido'")
            for field, flag in (("customer_name", "name_blank"), ("customer_email", "em_blank"))
        ],
        row(8, "MISSING_CUSTOMER_IDENTITY", "GDPR, PCI-DSS", "HIGH", "audit",
            "name_blank AND em_blank", pid,
            "'customer_name y customer_email nulos — cliente no identificable'"),
        *[
            table(9, "NULL_TIMESTAMP", "SOX, Basel III, DORA", "MEDIUM", "audit_trail", flag,
                  f"'''{field}'' nulo en '||count(*)||"
                  "' registros — audit trail incompleto'")
            for field, flag in (("created_at", "cr_blank"), ("updated_at", "up_blank"))
        ],
        table(10, "MISSING_SOURCE_SYSTEM", "SOX, Basel III, DORA", "MEDIUM", "audit_trail",
              "src_blank", "'source_system nulo en '||count(*)||"
              "' registros — linaje de datos no trazable'"),
        table(11, "INVALID_TRANSACTION_STATUS", "PCI-DSS, SOX", "HIGH", "financial_integrity",
              f"su IS NULL OR su NOT IN ({_quoted(fv.STATUSES)})",
              "count(*)||' registros con status nulo o no reconocido — integridad del ciclo"
              " de vida comprometida'"),
        system(12, "DORA_NO_AUDIT_LOG", "DORA, NIST_CSF", "HIGH",
               "Sistema sin audit log operacional — incumplimiento DORA Art. 9 y"
               " NIST CSF DE.AE"),
        system(13, "NIST_NO_ANOMALY_DETECTION", "NIST_CSF", "MEDIUM",
               "Sin mecanismo de detección de anomalías — NIST CSF DE.CM no implementado"),
        row(14, "EXTREME_AMOUNT", "AML, PCI-DSS, Basel III", "HIGH", "aml_compliance",
            "val > 1000000", pid,
            "'Monto extremo USD '||format('{:,.2f}', val)||' — requiere revisión manual AML'"),
    ]
    return "\nUNION ALL ".join(parts)


def _area(name: str, *areas: str) -> str:
    return (
        f"cast(coalesce(sum(coalesce(affected_records,1)) FILTER (risk_area IN"
        f" ({_quoted(areas)})),0) AS bigint) AS {name}"
    )


def _points(issues: str, points: int) -> str:
    return f"cast(round_even(({issues}::double/total)*{points}, 0) AS integer)"


def scores_ctes(g: str = "'all'") -> str:
    return base(g) + f""",
f AS ({_finding_rows()}),
area AS (
  SELECT g, count(*) AS findings, {_area("trace", "traceability")},
    {_area("fin", "financial_integrity")}, {_area("aud", "audit", "audit_trail")},
    {_area("enc", "encryption")}, {_area("sanc", "sanctions_compliance")},
    {_area("aml", "aml_compliance")}, {_area("res", "operational_resilience")}
  FROM f GROUP BY g),
s0 AS (
  SELECT dq.*, area.* EXCLUDE (g),
    greatest(25, least(100, 100 - least(25, {_points("fin", 60)})
      - CASE WHEN enc>0 THEN 25 ELSE 0 END - least(10, {_points("trace", 30)})
      - CASE WHEN sanc>0 THEN 15 ELSE 0 END)) AS pci,
    greatest(40, least(100, 100 - least(20, {_points("trace", 60)})
      - least(15, {_points("aud", 40)}))) AS sox,
    CASE WHEN enc>0 THEN 75 ELSE 18 END AS pii,
    CASE WHEN enc>0 THEN 30 ELSE 80 END AS cover,
    greatest(35, least(100, 100 - least(25, {_points("aud", 50)})
      - least(15, {_points("trace", 30)}))) AS auditab,
    cast(least(100, sanc*8) AS integer) AS ofac, cast(least(100, aml*15) AS integer) AS amlr,
    CASE WHEN res>0 THEN 85 ELSE 20 END AS dora
  FROM dq JOIN area ON dq.g IS NOT DISTINCT FROM area.g),
s AS (
  SELECT *, 38 AS cloud, 78 AS sec, 74 AS comp, 72 AS mig,
    greatest(0, least(100, cast(round_even((1-pci/100::double)*25 + (1-sox/100::double)*15
      + (pii/100::double)*20 + (1-cover/100::double)*15 + (1-auditab/100::double)*10
      + (ofac/100::double)*10 + (amlr/100::double)*5, 0) AS integer))) AS reg
  FROM s0)"""


SEGMENT_KEY = "coalesce(source_system,'-')||'/'||coalesce(country_code,'-')"
SYSTEM_KEY = "source_system"

def advice_ctes() -> str:
    weeks = [(s[0], s[1], s[2], s[3], s[4]) for s in fv.STRATEGIES]
    return scores_ctes(SEGMENT_KEY) + f""",
{_values("strategies", weeks, "strategy", "weeks", "risk", "monthly", "reason")},
{_values("shares", fv.ROLE_SHARES, "strategy", "role", "share")},
{_values("rates", fv.ROLE_RATES, "role", "rate")},
labour AS (
  SELECT strategy, weeks, monthly,
    cast(round_even(sum(weeks*40*share::double*rate)/1000,0)*1000 AS bigint) AS impl
  FROM shares JOIN rates USING (role) JOIN strategies USING (strategy)
  GROUP BY strategy, weeks, monthly),
invest AS (
  SELECT *, cast(round_even(impl*0.15::double/1000,0)*1000 AS bigint) AS cont,
    cast(312000-monthly*12 AS bigint) AS saving FROM labour),
cost AS (
  SELECT *, impl+cont AS total_inv, saving*3-(impl+cont) AS net,
    cast(round_even((impl+cont)/(saving/12::double),0) AS integer) AS payback,
    cast(round_even((saving*3-(impl+cont))/(impl+cont)::double*100,0) AS integer) AS roi
  FROM invest),
picked AS (
  SELECT *, cast(round_even((1-cloud/100::double)*40+(1-dq/100::double)*25
      +(reg/100::double)*20+least(findings/200::double,1.0::double)*15,0) AS integer) AS cplx,
    CASE WHEN cloud>=65 AND dq>=85 AND reg<=30 THEN 'rehost'
         WHEN cloud>=45 AND dq>=70 AND reg<=55 THEN 'replatform'
         WHEN cloud>=30 AND findings<=80 THEN 'refactor'
         WHEN reg>=70 OR findings>=150 THEN 'rebuild' ELSE 'hybrid' END AS strategy,
    cast(round_even(reg*0.30::double+(100-pci)*0.25::double+(100-sox)*0.15::double
      +pii*0.20::double+(100-cover)*0.10::double,0) AS integer) AS composite
  FROM s),
adv AS (
  SELECT picked.*, strategies.weeks, strategies.risk,
    CASE WHEN composite>=65 THEN 'HIGH' WHEN composite>=40 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM picked JOIN strategies USING (strategy))"""


def _text_rows(table, columns: dict[str, str], source: str, key: str) -> str:
    """Unpivot of scores with threshold texts."""
    parts = []
    for dimension, column, comparison, threshold, text, otherwise in table:
        score = columns[column] if column else "NULL"
        shown = f"'{text}'"
        if column:
            shown = (
                f"CASE WHEN {score} {comparison} {threshold} THEN '{text}'"
                f" ELSE '{otherwise}' END"
            )
        parts.append(
            f"SELECT {key}'{dimension}' AS dimension, cast({score} AS integer) AS score,"
            f" {shown} AS interpretation FROM {source}"
        )
    return " UNION ALL ".join(parts)


_SCORES = {
    "regulatory_risk_score": "reg", "pci_readiness_score": "pci",
    "sox_traceability_score": "sox", "pii_exposure_score": "pii",
    "encryption_coverage_score": "cover", "auditability_score": "auditab",
    "ofac_sanctions_score": "ofac", "aml_risk_score": "amlr", "dora_resilience_score": "dora",
}
_INPUTS = {
    "cloud_readiness_score": "cloud", "data_quality_score": "dq", "security_risk_score": "sec",
    "compliance_risk_score": "comp", "migration_risk_score": "mig", **_SCORES,
    "migration_complexity_score": "cplx",
}


def _as(columns: dict[str, str], *names: str) -> str:
    return ", ".join(f"{columns[n]} AS {n}" for n in names)


def _add(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = f"{ctes}\n{body}"


_ALL = ", ".join(PAYMENT_COLUMNS)
_GENERAL = "cast(round_even((dq+38+(100-78)+(100-74))/4::double,0) AS integer)"
_BASE, _BASE_SYS = base(), base(SYSTEM_KEY)
_S, _S_SYS, _ADV = scores_ctes(), scores_ctes(SYSTEM_KEY), advice_ctes()
_SUMMARY = (
    "total AS total_records, cast(14 AS bigint) AS total_rules, failed AS failed_rules,"
    " issues AS total_issues, total-err AS clean_records, err AS error_records,"
    " warn AS warning_records"
)

# ------------------------------------------------------------------ quality
_add("dq_normalized", _BASE, f"""SELECT row_id, id_blank, trim(status) AS status_text,
  cu AS currency_key, num AS amount_number, val AS amount_coerced,
  strftime(cts,{_TIME}) AS created_time,
  coalesce(regexp_full_match(em,'[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false) AS email_valid
FROM amt""")
_add("dq_display_texts", _BASE, """SELECT row_id, format('{:,.2f}', num) AS amount_text,
  CASE WHEN length(customer_email)>20 THEN substr(customer_email,1,20)||'...'
       ELSE coalesce(customer_email,'') END AS email_text FROM amt""")
for _i, _name in enumerate((
    "payment_id", "amount_missing", "amount_sign", "amount_limit", "completed_without_amount",
    "status", "currency", "country", "email_missing", "email_shape", "created_at",
    "updated_at", "country_currency", "source_system",
), 1):
    _level = "CRITICAL" if _i <= 4 else "WARNING"
    _add(f"dq_rule_{_name}", _BASE, f"SELECT row_id, '{_level}' AS level, c{_i} AS code"
         f" FROM codes WHERE c{_i} IS NOT NULL")
_add("dq_evaluation", _BASE, "SELECT row_id, critical, warning, is_error FROM ev")
_add("dq_clean_zone", _BASE, f"SELECT row_id, {_ALL} FROM ev WHERE NOT is_error")
_add("dq_errors_zone", _BASE,
     f"SELECT row_id, {_ALL}, all_codes AS dq_errors FROM ev WHERE is_error")
_add("dq_failures_by_code", _BASE,
     "SELECT family AS rule_name, n AS failed_records FROM fam")
_add("dq_failures_by_code_and_system", _BASE_SYS,
     "SELECT g AS source_system, family AS rule_name, n AS failed_records FROM fam")
_add("dq_summary", _BASE, f"SELECT {_SUMMARY} FROM q")
_add("dq_summary_by_system", _BASE_SYS, f"SELECT g AS source_system, {_SUMMARY} FROM q")
_HIGH = f"family IN ({_quoted(fv.HIGH_SEVERITY_CODES)})"
_add("dq_rule_detail", _BASE, f"""SELECT family AS rule_name, 'payments' AS target_table,
  n AS failed_records, CASE WHEN {_HIGH} THEN 'Alta' ELSE 'Media' END AS severity,
  'FAIL' AS status, n||' registros — '||CASE WHEN {_HIGH} THEN 'error critico'
  ELSE 'advertencia' END AS comments FROM fam ORDER BY n DESC, family""")
_add("dq_readiness", _BASE_SYS, f"""SELECT g AS source_system, dq AS data_quality_score,
  38 AS cloud_readiness_score, 78 AS security_risk_score, 74 AS compliance_risk_score,
  72 AS migration_risk_score, {_GENERAL} AS readiness_general FROM dq""")
_add("dq_readiness_texts", _BASE, _text_rows(
    fv.READINESS_TEXTS, {"data_quality_score": "dq", "readiness_general": _GENERAL}, "dq", ""))
_add("dq_zone_percentages", _BASE_SYS, """SELECT g AS source_system, total AS total_records,
  round_even((total-err)::double/total*100,1) AS pct_clean,
  round_even(err::double/total*100,1) AS pct_error FROM q""")
_LEGACY = "source_system='LEGACY_COBOL' AND num>40000"
_add("dq_custom_rule", _BASE, f"""SELECT family AS rule_name, n AS failed_records FROM fam
UNION ALL SELECT 'legacy_monto_alto', count(*) FROM amt
WHERE {_LEGACY} AND row_id%2=0 AND ct IS NOT NULL HAVING count(*)>0
UNION ALL SELECT 'legacy_sin_familia', count(*) FROM amt
WHERE {_LEGACY} AND row_id%2<>0 HAVING count(*)>0""")
_add("dq_custom_rule_summary", f"WITH {PAYMENTS}", """SELECT count(*) AS total_records,
  cast(1 AS bigint) AS total_rules,
  cast((count(*) FILTER (row_id%1000=1)>0)::int + (count(*) FILTER (row_id%1000=2)>0)::int AS bigint)
    AS failed_rules,
  count(*) FILTER (row_id%1000 IN (1,2)) AS total_issues, count(*) AS clean_records,
  cast(0 AS bigint) AS error_records, count(*) FILTER (row_id%1000 IN (1,2)) AS warning_records
FROM payments""")

# ------------------------------------------------------------------ compliance
_FINDING = ("rule_seq, rule, framework, severity, record, detail, risk_area,"
            " affected_records")
for _rule in ("MISSING_PAYMENT_ID", "INVALID_AMOUNT", "DUPLICATE_PAYMENT_ID",
              "OFAC_SANCTIONED_COUNTRY", "OFAC_SANCTIONED_CURRENCY",
              "AML_STRUCTURING_PATTERN", "PLAINTEXT_PII_FIELD", "MISSING_CUSTOMER_IDENTITY",
              "NULL_TIMESTAMP", "MISSING_SOURCE_SYSTEM", "INVALID_TRANSACTION_STATUS",
              "DORA_NO_AUDIT_LOG", "NIST_NO_ANOMALY_DETECTION", "EXTREME_AMOUNT"):
    _add(f"comp_{_rule.lower()}", _S, f"SELECT {_FINDING} FROM f WHERE rule = '{_rule}'")
_add("comp_duplicate_rows", _BASE, """SELECT row_id, payment_id FROM payments
WHERE payment_id IN (SELECT payment_id FROM payments WHERE payment_id IS NOT NULL
                     GROUP BY payment_id HAVING count(*)>1)""")
_add("comp_zone_union", _BASE, f"""SELECT row_id, {_ALL},
  CASE WHEN is_error THEN all_codes END AS dq_errors FROM ev""")
_add("comp_findings", _S, f"SELECT {_FINDING} FROM f")
_add("comp_findings_by_system", _S_SYS, """SELECT g AS source_system, rule,
  count(*) AS findings, cast(sum(coalesce(affected_records,1)) AS bigint) AS affected
FROM f GROUP BY g, rule""")
_add("comp_risk_areas", _S, """SELECT risk_area,
  cast(sum(coalesce(affected_records,1)) AS bigint) AS affected FROM f GROUP BY risk_area""")
_FRAMEWORK_CTE = _values(
    "frameworks", list(enumerate(fv.FRAMEWORKS, 1)), "framework_order", "name")
_PER_FRAMEWORK = """SELECT {key}framework_order, name AS framework, count(f.rule) AS findings
FROM {source} LEFT JOIN f ON list_contains(string_split(f.framework, ', '), name){on}
GROUP BY ALL"""
_add("comp_findings_by_framework", f"{_S}, {_FRAMEWORK_CTE}",
     _PER_FRAMEWORK.format(key="", source="frameworks", on=""))
_add("comp_framework_findings", _S, f"""SELECT {_FINDING} FROM f
WHERE list_contains(string_split(framework, ', '), 'AML')""")
_add("comp_custom_rule", _S, f"""SELECT {_FINDING} FROM f WHERE rule='EXTREME_AMOUNT'
UNION ALL SELECT 15, 'MANY_CURRENCIES', 'AML', 'MEDIUM', customer_name,
  count(DISTINCT currency_code)||' monedas', 'aml_compliance', count(*)
FROM payments WHERE customer_name IS NOT NULL GROUP BY customer_name
HAVING count(DISTINCT currency_code)>=6""")

# ------------------------------------------------------------------ scores
_add("score_risk_areas", _S_SYS, """SELECT g AS source_system, risk_area,
  cast(sum(coalesce(affected_records,1)) AS bigint) AS affected FROM f GROUP BY g, risk_area""")
_add("score_area_pivot", _S_SYS, """SELECT g AS source_system, trace AS traceability_issues,
  fin AS financial_issues, aud AS audit_issues, enc AS encryption_issues,
  sanc AS sanctions_issues, aml AS aml_issues, res AS resilience_issues FROM area""")
for _name, _columns in (
    ("pci_readiness", ("pci_readiness_score",)),
    ("sox_traceability", ("sox_traceability_score",)),
    ("pii_and_encryption", ("pii_exposure_score", "encryption_coverage_score")),
    ("auditability", ("auditability_score",)),
    ("sanctions_aml_resilience",
     ("ofac_sanctions_score", "aml_risk_score", "dora_resilience_score")),
    ("regulatory_risk", ("regulatory_risk_score",)),
):
    _add(f"score_{_name}", _S_SYS,
         f"SELECT g AS source_system, {_as(_SCORES, *_columns)} FROM s")
_add("score_regulatory", _S, f"SELECT {_as(_SCORES, *_SCORES)} FROM s")
_add("score_run_metadata", _S, """SELECT total AS total_records, total-err AS clean_records,
  err AS error_records, round_even(err::double/total*100,1) AS pct_error,
  findings AS total_findings,
  (SELECT string_agg(risk_area||'='||n, ', ' ORDER BY risk_area) FROM (
     SELECT risk_area, cast(sum(coalesce(affected_records,1)) AS bigint) AS n FROM f
     GROUP BY risk_area)) AS findings_by_area,
  (SELECT dq FROM dq) AS dq_score_input, 38 AS cloud_readiness_input FROM s""")
_add("score_texts", _S_SYS,
     _text_rows(fv.REGULATORY_TEXTS, _SCORES, "s", "g AS source_system, "))

# ------------------------------------------------------------------ advisor
_add("advisor_score_assembly", _ADV, f"""SELECT g AS system,
  {_as(_INPUTS, *fv.SCORE_DEFAULTS)}, findings FROM s""")
_add("advisor_strategy", _ADV, """SELECT g AS system, cplx AS migration_complexity_score,
  strategy, weeks AS effort_weeks, risk AS risk_level FROM adv""")
_add("advisor_costs", _ADV, """SELECT g AS system, strategy, impl AS implementation_cost_usd,
  cont AS contingency_usd, total_inv AS total_investment_usd,
  cast(monthly AS bigint) AS cloud_monthly_cost_usd,
  cast(monthly*12 AS bigint) AS cloud_annual_cost_usd,
  cast(312000 AS bigint) AS onpremises_annual_cost_usd, saving AS annual_savings_usd,
  payback AS payback_months, roi AS roi_3_years_pct, net AS cumulative_savings_3y_usd
FROM adv JOIN cost USING (strategy)""")
_add("advisor_risk_class", f"{_ADV}, " + _values(
    "classes", [(c[0], c[2], c[3], c[4]) for c in fv.RISK_CLASSES],
    "level", "label", "outcome", "fine"),
    """SELECT g AS system, composite AS composite_score, level AS regulatory_risk_level,
  label AS risk_label, outcome AS audit_outcome, fine AS fine_range
FROM adv JOIN classes USING (level)""")
_AT_RISK = " UNION ALL ".join(
    f"SELECT g AS system, '{name}' AS framework, "
    + ", ".join(
        f"cast({_INPUTS[column] if kind == k else 'NULL'} AS integer) AS {k}"
        for k in ("readiness", "exposure", "coverage")
    )
    + f", '{gap}' AS gap FROM adv WHERE {_INPUTS[column]} {comparison} {threshold}"
    for name, column, comparison, threshold, kind, gap in fv.FRAMEWORK_GAPS
)
_add("advisor_frameworks_at_risk", _ADV, _AT_RISK)
_add("advisor_complexity_by_dimension", _ADV, """
SELECT g AS system, 'application' AS dimension,
  CASE WHEN cloud<40 THEN 'HIGH' ELSE 'MEDIUM' END AS complexity FROM adv
UNION ALL SELECT g, 'data', CASE WHEN dq<70 THEN 'HIGH' ELSE 'MEDIUM' END FROM adv
UNION ALL SELECT g, 'security', 'HIGH' FROM adv
UNION ALL SELECT g, 'compliance', CASE WHEN level='HIGH' THEN 'HIGH' ELSE 'MEDIUM' END FROM adv
UNION ALL SELECT g, 'operational', 'MEDIUM' FROM adv""")
_add("advisor_alternatives", _ADV, """SELECT g AS system, adv.strategy,
  x.strategy AS alternative, x.reason AS reason_rejected
FROM adv JOIN strategies x ON x.strategy <> adv.strategy""")
for _name, _rows, _columns in (
    ("phases", [(*p[:4], " | ".join(p[4])) for p in fv.PHASES], ("phase", "name", "weeks_text", "actions")),
    ("services", fv.SERVICES, ("ord", "service")),
    ("team", fv.TEAMS, ("ord", "role", "dedication", "headcount")),
    ("risks", fv.RISKS, ("ord", "risk_text", "probability", "impact", "mitigation")),
    ("milestones", fv.MILESTONES, ("week", "milestone")),
):
    _shown = ", ".join(
        {"weeks_text": "weeks_text AS weeks", "risk_text": "risk_text AS risk"}.get(c, c)
        for c in _columns
    )
    _add(f"advisor_{_name}", f"{_ADV}, {_values('plan', _rows, 'strategy', *_columns)}",
         f"SELECT g AS system, strategy, {_shown} FROM adv JOIN plan USING (strategy)")
_add("advisor_duration", _ADV, """SELECT g AS system, weeks AS effort_weeks,
  round_even(weeks/4.3::double,1) AS duration_months FROM adv""")
_BENEFITS = ", ".join(f"cast({usd} AS bigint) AS {name}_usd" for name, usd in fv.BENEFITS)
_add("advisor_benefits", _ADV, f"""SELECT g AS system, strategy, {_BENEFITS},
  cast(292500 AS bigint) AS total_annual_benefit_usd,
  cast(monthly*12 AS bigint) AS cloud_annual_cost_usd,
  cast(292500-monthly*12 AS bigint) AS net_annual_savings_usd,
  saving AS model_annual_savings_usd FROM adv JOIN cost USING (strategy)""")

# ------------------------------------------------------------------ reports
_add("report_findings_by_severity", _S_SYS, """SELECT g AS source_system,
  CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END
    AS severity_order, severity, count(*) AS findings FROM f GROUP BY g, severity""")
_add("report_frameworks_with_findings", f"{_S_SYS}, {_FRAMEWORK_CTE}, per AS ("
     + _PER_FRAMEWORK.format(
         key="s.g, ", source="s, frameworks", on=" AND f.g IS NOT DISTINCT FROM s.g") + ")",
     """SELECT g AS source_system, count(*) FILTER (findings>0) AS frameworks_with_findings,
  cast(sum(findings) AS bigint) AS framework_findings FROM per GROUP BY g""")
_add("report_top_findings", _S, """SELECT rule_seq, severity, rule, record,
  framework AS frameworks, CASE WHEN length(detail)>90 THEN substr(detail,1,90)||'...'
  ELSE detail END AS detail
FROM (SELECT * FROM f ORDER BY rule_seq, record, f.detail LIMIT 50)""")


def _bands(dimensions) -> str:
    parts = []
    for i, (name, column, better) in enumerate(dimensions, 1):
        score = _INPUTS[column]
        risk = f"100-{score}" if better else score
        parts.append(
            f"SELECT g AS system, {i} AS position, '{name}' AS dimension, {score} AS score,"
            f" CASE WHEN {risk}>=70 THEN 'Alto Riesgo' WHEN {risk}>=40 THEN 'Moderado'"
            f" ELSE 'Adecuado' END AS band FROM adv"
        )
    return " UNION ALL ".join(parts)


_add("report_score_bands_workbook", _ADV, _bands(fv.WORKBOOK_DIMENSIONS))
_add("report_score_bands_page", _ADV, _bands(fv.PAGE_DIMENSIONS))
for _name, _column in (("country", "country_code"), ("system", "source_system"),
                       ("status", "status")):
    _add(f"report_payments_by_{_name}", f"WITH {PAYMENTS}",
         f"SELECT {_column}, count(amount) AS payments FROM payments GROUP BY {_column}")
_SANCTIONS = """SELECT payment_id, country_code, sanction_flag_expected, source_system,
  cast(sum(try_cast(trim(amount) AS decimal(18,2))) AS decimal(28,2)) AS total_amount
FROM payments {where} GROUP BY ALL"""
_add("report_sanctions_table", f"WITH {PAYMENTS}", _SANCTIONS.format(where=""))
_add("report_sanctions_table_filtered", f"WITH {PAYMENTS}", _SANCTIONS.format(
    where=f"WHERE country_code IN ({_quoted(fv.SANCTIONED_COUNTRIES)})"
          f" OR currency_code IN ({_quoted(fv.SANCTIONED_CURRENCIES)})"))
_TEAM_CTES = (
    f"{_ADV}, " + _values("plan", fv.TEAMS, "strategy", "ord", "role", "dedication", "headcount")
    + ", " + _values("team_rates", fv.TEAM_RATES, "role", "rate")
)
_add("report_role_costs", _TEAM_CTES, """SELECT g AS system, strategy, ord, plan.role,
  dedication, headcount, cast(round_even(weeks*40
    *(cast(replace(dedication,'%','') AS integer)/100::double)*coalesce(rate,150)*headcount
    /1000,0)*1000 AS bigint) AS cost_usd
FROM adv JOIN plan USING (strategy) LEFT JOIN team_rates ON plan.role = team_rates.role""")
_add("report_team_size", _TEAM_CTES, """SELECT g AS system, strategy,
  cast(sum(headcount) AS bigint) AS team_size FROM adv JOIN plan USING (strategy)
GROUP BY g, strategy""")
_add("report_cost_comparison", f"{_ADV}, " + _values(
    "lines", fv.COST_LINES, "ord", "line", "onprem", "cloud_usd") + """, detail AS (
  SELECT g, strategy, lines.ord, lines.line, cast(onprem AS bigint) AS o,
    cast(coalesce(lines.cloud_usd, monthly*12) AS bigint) AS c
  FROM adv JOIN cost USING (strategy), lines)""", """
SELECT g AS system, strategy, ord, line, 'line' AS kind, o AS onpremises_usd, c AS cloud_usd,
  o-c AS saving_usd FROM detail
UNION ALL SELECT g, strategy, 7, 'SUMA', 'sum', cast(sum(o) AS bigint), cast(sum(c) AS bigint),
  cast(sum(o-c) AS bigint) FROM detail GROUP BY g, strategy
UNION ALL SELECT g, strategy, 8, 'TOTAL', 'shown', cast(312000 AS bigint),
  cast(monthly*12+5000 AS bigint), saving FROM adv JOIN cost USING (strategy)""")
_add("report_services_by_layer", f"{_ADV}, "
     + _values("plan", fv.SERVICES, "strategy", "ord", "service") + ", "
     + _values("categories", fv.SERVICE_CATEGORIES, "service", "category") + ", "
     + _values("layers", fv.CATEGORY_LAYERS, "category", "layer"),
     """SELECT g AS system, strategy, coalesce(layer,'Operaciones') AS layer,
  count(*) AS services, string_agg(service, ', ' ORDER BY service) AS service_names
FROM adv JOIN plan USING (strategy) LEFT JOIN categories USING (service)
LEFT JOIN layers USING (category) GROUP BY ALL""")
_add("report_framework_scores", f"{_ADV}, at_risk AS ({_AT_RISK})", """SELECT system,
  framework, gap, coalesce(nullif(readiness,0), nullif(exposure,0), coverage) AS score
FROM at_risk""")
_add("report_alerts", scores_ctes(SEGMENT_KEY),
     "SELECT g AS system, ofac>0 AS ofac_alert, amlr>0 AS aml_alert FROM s")
_add("report_batch_profile", _BASE, f"""SELECT count(*) AS total_records,
  count(*) FILTER (n>1) AS duplicate_records,
  count(*) FILTER (country_code IN ({_quoted(fv.PROFILE_SANCTIONED_COUNTRIES)})) AS sanctioned_records,
  count(*) FILTER (val>=9000 AND val<10000) AS near_limit_records,
  count(*) FILTER (val<0) AS negative_records,
  count(*) FILTER (payment_id IS NULL) AS null_id_records,
  count(*) FILTER (source_system='LEGACY_COBOL') AS legacy_records
FROM (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n FROM amt)""")
_add("report_value_counts", f"WITH {PAYMENTS}",
     "SELECT source_system, count(*) AS records FROM payments GROUP BY source_system")
_KPIS = ("upper(strategy)", "weeks", "total_inv", "saving", "payback", "roi", "net",
         "findings", "reg", "dq")
_add("report_key_figures", f"{_ADV}, k AS (SELECT adv.*, cost.total_inv, cost.saving,"
     " cost.payback, cost.roi, cost.net FROM adv JOIN cost USING (strategy))",
     " UNION ALL ".join(
         f"SELECT g AS system, {i} AS ord, '{name}' AS kpi, cast({value} AS varchar) AS value"
         f" FROM k" for i, (name, value) in enumerate(zip(fv.KPI_NAMES, _KPIS), 1)))

# ------------------------------------------------------------------ sources and sinks
_add("io_payments_view", f"WITH {PAYMENTS}", "SELECT * FROM payments")
_add("io_extract_projection", f"WITH {PAYMENTS}",
     "SELECT * REPLACE (created_at AS updated_at) FROM payments")
_add("io_csv_round_trip", f"WITH {PAYMENTS}", "SELECT * FROM payments")
_add("io_json_round_trip", _S, f"""SELECT '2026-01-01T00:00:00Z' AS generated_at,
  'payments' AS system, {_as(_SCORES, *_SCORES)}, total AS total_records,
  findings AS total_findings, sanc AS sanctions, CASE WHEN amlr>0
  THEN 'CRÍTICO — patrones AML detectados' ELSE 'Sin patrones AML' END AS aml_text FROM s""")
_add("comp_report_documents", _S, """SELECT rule, severity, framework, count(*) AS findings
FROM f GROUP BY ALL""")
_add("io_zone_routing", _BASE, """SELECT row_id, CASE WHEN is_error THEN 'errors'
  ELSE 'clean' END AS zone, CASE WHEN is_error THEN all_codes END AS dq_errors FROM ev""")
_add("io_zone_tables", _BASE, """
SELECT 'payments_raw' AS table_name, row_id, payment_id, customer_name, amount,
  cast(NULL AS varchar) AS dq_errors FROM ev
UNION ALL SELECT 'payments_clean', row_id, payment_id, customer_name, amount, NULL
  FROM ev WHERE NOT is_error
UNION ALL SELECT 'payments_errors', row_id, payment_id, customer_name, amount, all_codes
  FROM ev WHERE is_error""")
_add("io_csv_by_name", f"WITH {PAYMENTS}", """SELECT row_id, payment_id, amount,
  customer_name||chr(10)||'"first",'||chr(13)||chr(10)||'second; '||amount AS customer_name,
  cast(NULL AS varchar) AS currency_code, 'x' AS unknown_column FROM payments""")
_add("io_compliance_scores_table", _S, f"""SELECT {_as(_SCORES, *_SCORES)},
  '2026-01-01T00:00:00Z' AS generated_at, 'payments' AS system FROM s""")
_add("io_dq_summary_table", _BASE, f"""SELECT dq AS data_quality_score,
  38 AS cloud_readiness_score, 78 AS security_risk_score, 74 AS compliance_risk_score,
  72 AS migration_risk_score, {_GENERAL} AS readiness_general,
  '2026-01-01 00:00:00' AS generated_at FROM dq""")
_add("io_catalog_lifecycle", f"WITH {PAYMENTS}", """SELECT false AS before_create,
  true AS after_create, false AS after_drop, count(*) AS records FROM payments""")
_add("io_full_refresh", _BASE, """SELECT row_id, 'CRITICAL' AS level, c2 AS code FROM codes
WHERE c2 IS NOT NULL""")
_add("io_preview", f"WITH {PAYMENTS}", "SELECT * FROM payments ORDER BY row_id LIMIT 3")

_add("io_csv_split", f"WITH {PAYMENTS}", """SELECT row_id, amount, cast(NULL AS varchar) AS status,
  'line'||chr(10)||chr(10)||'"'||customer_name||'",'||chr(13)||chr(10)||payment_id AS customer_name
FROM payments""")
_add("io_atomic_refresh", _BASE, """SELECT 1 AS version_number, row_id, c2 AS code FROM codes
WHERE c2 IS NOT NULL UNION ALL SELECT 2, row_id, c1 FROM codes WHERE c1 IS NOT NULL""")
ORACLE["dq_incremental_summary"] = ORACLE["dq_summary_by_system"]
ORACLE["dq_incremental_failures"] = ORACLE["dq_failures_by_code_and_system"]
_add("comp_incremental_findings", _S, f"""SELECT {_FINDING} FROM f
WHERE rule IN ('DUPLICATE_PAYMENT_ID', 'AML_STRUCTURING_PATTERN')""")
ORACLE["comp_incremental_risk_areas"] = ORACLE["comp_risk_areas"]
_add("io_stream_zones", _BASE, """SELECT row_id, CASE WHEN is_error THEN 'errors' ELSE 'clean' END AS zone,
  CASE WHEN is_error THEN all_codes END AS dq_errors, warning FROM ev""")

# ------------------------------------------------------------------ batch rules, clustered zones
_IBAN_DIGITS = "lpad(cast(98 - cast(own||'131400' AS hugeint) % 97 AS varchar), 2, '0')"
_IBANS = f"""ibans AS (SELECT row_id, payment_id, amount, replace(upper(CASE
    WHEN row_id%17=1 THEN NULL WHEN row_id%19=2 THEN '  ' WHEN row_id%23=3 THEN 'DE00'||own
    WHEN row_id%29=4 THEN 'de'||{_IBAN_DIGITS}||' '||own WHEN row_id%31=5 THEN 'DE12 345'
    WHEN row_id%37=6 THEN 'GB82WEST12345698765432'
    WHEN row_id%41=7 THEN 'GB82 TEST 1234 5698 7654 32'
    ELSE 'DE'||{_IBAN_DIGITS}||own END), ' ', '') AS x
  FROM (SELECT *, lpad(cast(row_id AS varchar), 18, '0') AS own FROM payments)),
iban_codes AS (SELECT row_id, CASE WHEN coalesce(x, '') = '' THEN NULL
    WHEN NOT regexp_full_match(x, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN 'iban_formato_invalido'
    WHEN list_reduce(list_prepend(0, list_transform(string_split(substr(x, 5)||substr(x, 1, 4), ''),
      lambda c: CASE WHEN c >= 'A' THEN ascii(c)-55 ELSE ascii(c)-48 END)),
      lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) <> 1
    THEN 'iban_digito_control' END AS code FROM ibans)"""
_add("dq_batch_rule", f"{_BASE}, {_IBANS}", """
SELECT family AS rule_name, n AS failed_records FROM fam
UNION ALL SELECT code, count(*) FROM iban_codes WHERE code IS NOT NULL GROUP BY code""")
_add("dq_batch_rule_evaluation", f"{_BASE}, {_IBANS}", """
SELECT row_id, c1 IS NOT NULL OR c2 IS NOT NULL OR code IS NOT NULL AS is_error,
  nullif(concat_ws(' | ', '[C]'||c1, '[C]'||c2, '[C]'||code), '') AS dq_errors
FROM codes JOIN iban_codes USING (row_id)""")
_add("io_clustered_zones", _BASE, """SELECT row_id, payment_id, CASE WHEN is_error THEN 'errors'
  ELSE 'clean' END AS zone, CASE WHEN is_error THEN all_codes END AS dq_errors FROM ev""")
_add("comp_clustered_duplicate_rows", _BASE, """SELECT row_id, payment_id, CASE WHEN is_error
  THEN 'errors' ELSE 'clean' END AS zone FROM (SELECT *, count(*) OVER (PARTITION BY payment_id) AS n FROM ev)
WHERE payment_id IS NOT NULL AND n > 1""")
_add("comp_clustered_duplicates", f"WITH {PAYMENTS}", """SELECT payment_id, count(*) AS affected_records
FROM payments WHERE payment_id IS NOT NULL GROUP BY payment_id HAVING count(*) > 1""")
ORACLE["report_clustered_batch_profile"] = ORACLE["report_batch_profile"]
_add("io_zone_statistics", _BASE, """SELECT CASE WHEN is_error THEN 'errors' ELSE 'clean' END AS zone,
  count(*) AS known_records, sum(count(*)) OVER ()::bigint AS known_total,
  sum(count(*) FILTER (payment_id IS NULL)) OVER ()::bigint AS known_null_ids,
  count(*) AS records, count(*) FILTER (payment_id IS NULL) AS null_ids FROM ev GROUP BY ALL""")
