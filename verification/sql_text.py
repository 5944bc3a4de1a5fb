"""DuckDB SQL layers for dossier texts, extraction, chunks, term weights and the audit."""

from claimweir import fixed
from claimweir.functions.text import WHITE
from verification.bindings import AREA_TEXTS
from verification.sql import COUNTY, PPSN_HASH, PPSN_VALID, RECURSIVE, ROUTING, STAMP, layer

NL = "chr(10)"


def strip(text: str) -> str:
    return f"trim({text}, '{WHITE}')"


def euro(cents: str) -> str:
    return f"format('{{:,.2f}}', cast({cents} AS DOUBLE) / 100)"


layer(
    "numbered",
    """
    SELECT *, CASE WHEN order_key % 50 = 7 THEN -1 ELSE 1 END AS sign,
           list_transform(range(1, order_key % 7 + 1), lambda i:
             (2 * cast(cast(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) + i + 1) // (2 * (i + 1))) AS amounts
    FROM hdr
    """,
    "hdr",
)
layer(
    "priced",
    """
    SELECT *, list_transform(amounts, lambda a: (2 * a * (order_key % 5) + 100) // 200) AS deductibles
    FROM numbered
    """,
    "numbered",
)
layer(
    "dossiers",
    f"""
    SELECT order_key, 'claim_' || order_key || '.txt' AS file_name,
      'inbound/claim_' || order_key || '.txt' AS file_path,
      concat_ws({NL},
      'STATUS: ' || status_banner,
      CASE WHEN order_key % 29 <> 0 THEN 'DOSSIER ID: ' || claim_id END,
      'Policy Number: ' || policy_printed,
      CASE WHEN order_key % 20 <> 1 THEN 'Filing Date: ' || filing_date END,
      CASE WHEN order_key % 20 <> 2 THEN 'Incident Date: ' || incident_date END,
      'Notice Latency: ' || days_to_notify || ' days (Compliant SLA)',
      'DORA Tier: ' || dora_classification,
      'Claimant Name: ' || claimant_name,
      'Claimant PPSN: ' || claimant_ppsn,
      'Contact Email: ' || claimant_email,
      'Contact Phone: ' || claimant_phone,
      'Loss Location: ' || loss_location || ' [' || eircode || ']',
      CASE WHEN order_key % 31 <> 0 THEN 'Incident Type: ' || incident_type END,
      'INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION',
      incident_description,
      'Reported on ' || incident_date,
      'ITEMIZED FINANCIAL LOSS ASSESSMENT (EUR)',
      'Category Gross Deductible Net Claim',
      coalesce(array_to_string(list_transform(range(1, len(amounts) + 1), lambda i:
        {euro('sign * amounts[i]')} || ' ' || {euro('deductibles[i]')} || ' ' ||
        {euro('sign * (amounts[i] - deductibles[i])')}), {NL}), ''),
      'TOTALS Aggregated Claim Liquidation Value ' || {euro('sign * coalesce(list_sum(amounts), 0)')} || ' ' ||
        {euro('coalesce(list_sum(deductibles), 0)')} || ' ' ||
        {euro('sign * (coalesce(list_sum(amounts), 0) - coalesce(list_sum(deductibles), 0))')},
      'STATUTORY DECLARATION: I certify.',
      'Claimant / Authorized Representative') AS text
    FROM priced
    """,
    "priced",
)


def find(pattern: str, group: int = 1) -> str:
    return f"nullif({strip(f'''regexp_extract(text, '{pattern}', {group})''')}, '')"


MONEY = r"(-?\d[\d,]*\.\d{2})"
TRIPLE = rf"{MONEY}\s+{MONEY}\s+{MONEY}"
SECTION = r"(?s)ITEMIZED FINANCIAL LOSS ASSESSMENT.*?Net Claim.*?\n(.*?)\s+TOTALS"


def amount(text: str) -> str:
    return f"cast(replace({text}, ',', '') AS DOUBLE)"


def total(group: int) -> str:
    pattern = rf"TOTALS\s+Aggregated Claim Liquidation Value\s+{TRIPLE}"
    return f"coalesce({amount(find(pattern, group))}, 0.0)"


POLICY = (
    f"CASE WHEN regexp_matches(upper({find(r'Policy Number:\s*([^\n\r]+)')}), 'MISSING|NOT PROVIDED|NONE|N/A') "
    f"THEN NULL ELSE {find(r'Policy Number:\s*([^\n\r]+)')} END"
)
CLAIM = (
    f"coalesce({find(r'(?:Claim Reference:|DOSSIER ID:)\s*([A-Z0-9\-]+)')}, "
    "'CLM-UNKNOWN-' || regexp_replace(file_name, '[.]txt$', ''))"
)
FILING = f"coalesce({find(r'Filing Date:\s*(\d{4}-\d{2}-\d{2})')}, '2026-02-01')"
INCIDENT = f"coalesce({find(r'Incident Date:\s*(\d{4}-\d{2}-\d{2})')}, {FILING})"
DAYS = f"coalesce(cast({find(r'Notice Latency:\s*(\d+)\s*days')} AS BIGINT), 0)"
TIER = f"coalesce({find(r'DORA Tier:\s*([^\n\r]+)')}, 'Standard Operational Claim (Non-ICT)')"
LOCATION = (
    "nullif(trim(replace(regexp_extract(text, "
    rf"'Loss Location:\s*([^\n\r]+(?:\n[^\n\r]+)?)', 1), {NL}, ' ')), '')"
)
EIRCODE = find(r"\[([A-Z0-9]{3}\s+[A-Z0-9]{4})\]")
INCIDENT_TYPE = find(r"Incident Type:\s*([^\n\r]+)")
DESCRIPTION = find(
    r"(?s)INCIDENT SYNOPSIS & REGULATORY CLASSIFICATION\s*(.*?)\s*ITEMIZED FINANCIAL LOSS ASSESSMENT"
)
ATTESTATION = find(r"(?s)STATUTORY DECLARATION:\s*(.*?)\s*Claimant / Authorized")

layer(
    "extracted",
    f"""
    SELECT order_key, file_name, text, {CLAIM} AS claim_id, {POLICY} AS policy_number,
      {find(r'STATUS:\s*([^\n\r]+)')} AS status_banner, {FILING} AS filing_date, {INCIDENT} AS incident_date,
      {DAYS} AS days_to_notify, {TIER} AS dora_classification,
      {find(r'Claimant Name:\s*([^\n\r]+)')} AS claimant_name,
      {find(r'Claimant PPSN:\s*([^\n\r]+)')} AS claimant_ppsn,
      {find(r'Contact Email:\s*([^\n\r]+)')} AS claimant_email,
      {find(r'Contact Phone:\s*([^\n\r]+)')} AS claimant_phone,
      {LOCATION} AS loss_location, {EIRCODE} AS eircode, {INCIDENT_TYPE} AS incident_type,
      {DESCRIPTION} AS incident_description, 'EUR' AS currency,
      {total(1)} AS total_loss_amount, {total(2)} AS total_deductible, {total(3)} AS total_net_claimed,
      {ATTESTATION} AS statutory_attestation
    FROM dossiers
    """,
    "dossiers",
)
layer(
    "items",
    rf"""
    SELECT claim_id, position, 'Operational Loss Item ' || position AS category,
      'Incurred expense during event mitigation for ' || coalesce(incident_type, 'claim') || '.' AS description,
      {amount(rf"regexp_extract(line, '{TRIPLE}', 1)")} AS amount,
      {amount(rf"regexp_extract(line, '{TRIPLE}', 2)")} AS deductible,
      {amount(rf"regexp_extract(line, '{TRIPLE}', 3)")} AS net_claimed
    FROM (SELECT claim_id, incident_type, unnest(found) AS line, generate_subscripts(found, 1) AS position
          FROM (SELECT claim_id, incident_type,
                       regexp_extract_all(regexp_extract(text, '{SECTION}', 1), '{TRIPLE}') AS found
                FROM extracted))
    """,
    "extracted",
)

layer(
    "text_gate",
    f"""
    SELECT claim_id, claimant_ppsn_hash, loss_county, eircode_routing_key,
      cast(round(cast(cast(r1 AS INT) + cast(r2 AS INT) + cast(r3 AS INT) + 1 + cast(r5 AS INT) + cast(r6 AS INT) +
           cast(r7 AS INT) AS DOUBLE) / 7, 4) AS DOUBLE) AS quality_score,
      r1 AND r2 AND r3 AND (cast(r5 AS INT) + cast(r6 AS INT) + cast(r7 AS INT)) >= 2 AS is_valid,
      concat_ws(', ', CASE WHEN NOT r1 THEN 'RULE_POLICY_NUMBER_PRESENT' END,
        CASE WHEN NOT r2 THEN 'RULE_POSITIVE_AMOUNTS' END, CASE WHEN NOT r3 THEN 'RULE_TIMELY_NOTIFICATION' END,
        CASE WHEN NOT r5 THEN 'RULE_VALID_PPSN_FORMAT' END, CASE WHEN NOT r6 THEN 'RULE_LEDGER_RECONCILED' END,
        CASE WHEN NOT r7 THEN 'RULE_METADATA_COMPLETENESS' END) AS failed_rules
    FROM (SELECT *, policy_number IS NOT NULL AS r1,
            total_net_claimed > 0 AND total_loss_amount > 0 AND coalesce(least_amount > 0, true)
              AND coalesce(least_net > 0, true) AS r2,
            days_to_notify <= 90 AS r3, {PPSN_VALID} AS r5,
            net_total IS NOT NULL AND abs(net_total - cast(total_net_claimed AS DECIMAL(18,2))) < 0.05 AS r6,
            loss_county <> 'Unknown County' AS r7
          FROM (SELECT e.*, {PPSN_HASH} AS claimant_ppsn_hash, {COUNTY} AS loss_county,
                       {ROUTING} AS eircode_routing_key, least_amount, least_net, net_total
                FROM extracted e LEFT JOIN (
                  SELECT claim_id, min(amount) AS least_amount, min(net_claimed) AS least_net,
                         sum(cast(net_claimed AS DECIMAL(18,2))) AS net_total
                  FROM items GROUP BY claim_id) USING (claim_id)))
    """,
    "extracted",
    "items",
)

# --- chunks -------------------------------------------------------------------------------------------------------

HEADER = r"(?i)(SECTION\s+(\d+)\s*:[^\n]+)"
BARE_HEADER = r"(?i)SECTION\s+\d+\s*:[^\n]+"


def chunk_layers(prefix: str, addition: str, where: str) -> None:
    """The chunk layers over documents with some text added, under names with a prefix."""
    names = {n: prefix + n for n in ("sectioned", "split_up", "sections", "paragraphs", "packed", "chunks")}
    layer(
        names["sectioned"],
        f"""
    SELECT doc_id, 'doc_' || doc_id AS stem, 'doc_' || doc_id || '.txt' AS file_name,
      'Preamble ' || lang || {NL} || {NL} || 'SECTION ' || (doc_id % 7 + 1) || ': ' || source || {NL} ||
        replace(text, {NL}, {NL} || {NL}) || {addition} AS text
    FROM documents WHERE {where}
    """,
    )
    layer(
        names["split_up"],
        rf"""
    SELECT stem, file_name, text, regexp_extract_all(text, '{HEADER}', 1) AS headers,
      regexp_extract_all(text, '{HEADER}', 2) AS numbers, string_split_regex(text, '{BARE_HEADER}') AS bodies
    FROM {names["sectioned"]}
    """,
        names["sectioned"],
    )
    layer(
        names["sections"],
        f"""
    SELECT stem, file_name, i, {strip('headers[i]')} AS section, cast(numbers[i] AS BIGINT) AS section_number,
      {strip('bodies[i + 1]')} AS body
    FROM (SELECT *, unnest(range(1, len(headers) + 1)) AS i FROM {names["split_up"]})
    """,
        names["split_up"],
    )
    layer(
        names["paragraphs"],
        f"""
    SELECT stem, i, row_number() OVER (PARTITION BY stem, i ORDER BY place) AS p, paragraph, section
    FROM (SELECT stem, i, section, place, {strip('raw')} AS paragraph
          FROM (SELECT stem, i, section, unnest(parts) AS raw, generate_subscripts(parts, 1) AS place
                FROM (SELECT stem, i, section, string_split(body, {NL} || {NL}) AS parts FROM {names["sections"]})))
    WHERE paragraph <> '' AND paragraph <> section
    """,
        names["sections"],
    )
    RECURSIVE.add(names["packed"])
    layer(
        names["packed"],
        f"""
    SELECT stem, i, section, cast(0 AS BIGINT) AS p, section AS open, length(section) AS len, 0 AS taken, 0 AS part,
      cast(NULL AS VARCHAR) AS finished
    FROM {names["sections"]}
    UNION ALL
    SELECT stem, i, section, p,
      CASE WHEN full_up THEN section ELSE open END || {NL} || {NL} || paragraph,
      CASE WHEN full_up THEN length(section) ELSE len END + length(paragraph),
      CASE WHEN full_up THEN 1 ELSE taken + 1 END,
      part + CASE WHEN full_up THEN 1 ELSE 0 END,
      CASE WHEN full_up THEN open END
    FROM (SELECT k.stem, k.i, k.section, q.p, k.open, k.len, k.taken, k.part, q.paragraph,
                 k.len + length(q.paragraph) > 1000 AND k.taken > 0 AS full_up
          FROM {names["packed"]} k
          JOIN {names["paragraphs"]} q ON q.stem = k.stem AND q.i = k.i AND q.p = k.p + 1)
    """,
        names["paragraphs"],
    )
    layer(
        names["chunks"],
        f"""
    SELECT stem || '_preamble_0' AS chunk_id, {strip('bodies[1]')} AS text, file_name AS source_file,
      'PREAMBLE & JURISDICTION' AS section, 0 AS section_number
    FROM {names["split_up"]} WHERE len(headers) > 0 AND {strip('bodies[1]')} <> ''
    UNION ALL
    SELECT stem || '_full_0', {strip('text')}, file_name, 'GENERAL GUIDELINES', 1
    FROM {names["split_up"]} WHERE len(headers) = 0
    UNION ALL
    SELECT t.stem || '_sec' || s.section_number || '_part' || t.part, t.text, s.file_name, s.section, s.section_number
    FROM (SELECT stem, i, part - 1 AS part, finished AS text FROM {names["packed"]} WHERE finished IS NOT NULL
          UNION ALL
          SELECT stem, i, max(part), arg_max(open, p) FROM {names["packed"]} GROUP BY stem, i) t
    JOIN {names["sections"]} s ON s.stem = t.stem AND s.i = t.i
    """,
        names["packed"],
        names["sections"],
        names["split_up"],
    )


chunk_layers("", "''", "true")
chunk_layers("amended_", f"{NL} || {NL} || 'Amended.'", "lang = 'fr'")

# --- term weights -------------------------------------------------------------------------------------------------


def words(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


layer(
    "term_counts",
    f"""
    SELECT chunk_id, section_number, token, count(*) AS times
    FROM (SELECT chunk_id, section_number, unnest({words('text')}) AS token FROM chunks)
    GROUP BY chunk_id, section_number, token
    """,
    "chunks",
)
layer(
    "rarity",
    """
    SELECT token, cast(round(ln((1 + (SELECT count(*) FROM chunks)) / cast(1 + count(*) AS DOUBLE)) + 1, 6)
                       AS DECIMAL(12,6)) AS rarity
    FROM term_counts GROUP BY token
    """,
    "term_counts",
)
layer(
    "terms",
    """
    SELECT chunk_id, section_number, token, cast(times * rarity AS DECIMAL(16,6)) AS weight
    FROM term_counts JOIN rarity USING (token)
    """,
    "term_counts",
    "rarity",
)
layer(
    "norms",
    "SELECT chunk_id, sum(cast(weight AS DECIMAL(19,6)) * cast(weight AS DECIMAL(19,6))) AS square FROM terms GROUP BY chunk_id",
    "terms",
)


def queries_of(named: list[tuple[str, str, int | None]]) -> str:
    rows = ", ".join(
        f"('{name}', '{text}', {'NULL' if section is None else section})" for name, text, section in named
    )
    return f"SELECT * FROM (VALUES {rows}) AS q(query, text, wanted)"


layer(
    "preset_asked",
    queries_of([(f"preset_{i}", text, None) for i, text in enumerate(fixed.PRESET_QUESTIONS)]),
)
layer(
    "area_asked",
    queries_of([(area, AREA_TEXTS[area], section) for area, section, *_ in fixed.AUDIT_AREAS]),
)


def hits(prefix: str, top_k: int) -> None:
    layer(
        f"{prefix}_hits",
        f"""
    SELECT query, rank, chunk_id, c.text, c.section, c.section_number, c.source_file, cosine,
      round(greatest(0, 1 - (1 - cosine)), 4) AS similarity_score
    FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, chunk_id) AS rank
          FROM (SELECT query, chunk_id,
                       cast(product AS DOUBLE) / sqrt(cast(query_square AS DOUBLE) * cast(square AS DOUBLE)) AS cosine
                FROM (SELECT query, chunk_id, sum(cast(weight AS DECIMAL(19,6)) * cast(query_weight AS DECIMAL(19,6))) AS product
                      FROM terms JOIN {prefix}_weights USING (token)
                      WHERE wanted IS NULL OR wanted = section_number
                      GROUP BY query, chunk_id)
                JOIN norms USING (chunk_id)
                JOIN (SELECT query, sum(cast(query_weight AS DECIMAL(19,6)) * cast(query_weight AS DECIMAL(19,6))) AS query_square
                      FROM {prefix}_weights GROUP BY query) USING (query)))
    JOIN chunks c USING (chunk_id)
    WHERE rank <= {top_k}
    """,
        f"{prefix}_weights",
        "norms",
        "terms",
        "chunks",
    )


layer("item_asked", "SELECT 'item_' || item_id AS query, text, cast(NULL AS BIGINT) AS wanted FROM benchmark")
for prefix in ("preset", "area", "item"):
    layer(
        f"{prefix}_weights",
        f"""
    SELECT query, wanted, token, cast(times * rarity AS DECIMAL(16,6)) AS query_weight
    FROM (SELECT query, wanted, token, count(*) AS times
          FROM (SELECT query, wanted, unnest({words('text')}) AS token FROM {prefix}_asked)
          GROUP BY query, wanted, token)
    JOIN rarity USING (token)
    """,
        f"{prefix}_asked",
        "rarity",
    )
hits("preset", 3)
hits("area", 1)
hits("item", 3)

layer(
    "fallbacks",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{heading}', '{excerpt}')" for a, _, _, heading, excerpt, _ in fixed.AUDIT_AREAS)
    + ") AS f(area, heading, fallback)",
)
layer(
    "citations",
    f"""
    SELECT area, coalesce(section, heading) AS regulatory_section,
      coalesce({strip(f"replace(left(text, 220), {NL}, ' ')")}, fallback) AS excerpt,
      coalesce(similarity_score, 0.0) AS similarity_score
    FROM fallbacks LEFT JOIN area_hits ON area = query AND rank = 1
    """,
    "fallbacks",
    "area_hits",
)

# --- audit --------------------------------------------------------------------------------------------------------

layer(
    "population",
    """
    SELECT claim_id, policy_number, days_to_notify, dora_classification, total_net_claimed, claimant_ppsn_hash
    FROM silver
    UNION ALL
    SELECT claim_id, policy_number, days_to_notify, dora_classification, total_net_claimed, claimant_ppsn_hash
    FROM quarantine
    """,
    "silver",
    "quarantine",
)
layer(
    "judged",
    """
    SELECT *, days_to_notify > 90 AS late,
      policy_number IS NULL OR trim(policy_number) IN ('', 'None', 'null', '[MISSING]') AS unidentified,
      total_net_claimed < 0 AS negative,
      NOT coalesce(starts_with(claimant_ppsn_hash, 'PPSN_'), false) AS unhashed
    FROM population
    """,
    "population",
)
layer(
    "reports",
    f"""
    SELECT claim_id,
      CASE WHEN late OR unidentified OR negative THEN 'REGULATORY_BREACH'
           WHEN unhashed THEN 'REQUIRES_REVIEW' ELSE 'COMPLIANT' END AS overall_verdict,
      policy_number, total_net_claimed, days_to_notify, dora_classification, late, unidentified, negative, unhashed,
      cast(late AS INT) + cast(unidentified AS INT) + cast(negative AS INT) AS num_breaches,
      concat_ws(', ', CASE WHEN late THEN 'CBI-DORA Section 3.2 (90-Day SLA Limit)' END,
        CASE WHEN unidentified THEN 'CBI-DORA Section 4.1 & 4.2 (Mandatory Policy Identification)' END,
        CASE WHEN negative THEN 'CBI-DORA Section 5.2 (Negative Liquidation Prohibition)' END) AS cited_articles,
      '{STAMP}' AS audit_timestamp,
      CASE WHEN late OR unidentified OR negative THEN
        'AUDIT FAILED: Claim ' || claim_id || ' contains ' ||
        (cast(late AS INT) + cast(unidentified AS INT) + cast(negative AS INT)) || ' statutory breach(es): ' ||
        concat_ws(', ', CASE WHEN late THEN 'STATUTORY_NOTIFICATION_SLA' END,
          CASE WHEN unidentified THEN 'MANDATORY_POLICY_NUMBER' END,
          CASE WHEN negative THEN 'FINANCIAL_VALUATION_INTEGRITY' END) ||
        '. Quarantined pending supervisory certification.'
      WHEN unhashed THEN 'AUDIT CONDITIONAL: Claim ' || claim_id || ' flagged for review (1 warning).'
      ELSE 'AUDIT PASSED: Claim ' || claim_id || ' fully satisfies Central Bank of Ireland and DORA statutory '
        || 'requirements across filing latency, policy validity, valuation, and privacy.' END AS supervisory_summary
    FROM judged
    """,
    "judged",
)
_CASES = [
    (
        "STATUTORY_NOTIFICATION_SLA",
        "late",
        "BREACH",
        "'Claim filed ' || days_to_notify || ' days post-incident, violating the statutory 90-day notification window "
        "mandated by Central Bank of Ireland and DORA Article 19.'",
        "'Claim notification latency of ' || days_to_notify || ' days satisfies the statutory SLA.'",
    ),
    (
        "MANDATORY_POLICY_NUMBER",
        "unidentified",
        "BREACH",
        "'Policy number is absent or placeholder. Financial liquidation cannot proceed against unverified "
        "contractual relationships under the CBI Consumer Protection Code.'",
        "'Valid insurance policy reference verified: ''' || policy_number || '''.'",
    ),
    (
        "FINANCIAL_VALUATION_INTEGRITY",
        "negative",
        "BREACH",
        "'Net liquidation requested amount of EUR ' || format('{:,.2f}', total_net_claimed) || ' is negative. "
        "Classified as critical accounting irregularity or unauthorized chargeback.'",
        "'Requested net indemnity of EUR ' || format('{:,.2f}', total_net_claimed) || ' is positive and compliant.'",
    ),
    (
        "GDPR_DATA_PRIVACY_PPSN",
        "unhashed",
        "WARNING",
        "'Pseudonymized PPSN token could not be verified in the record payload.'",
        "'Irish PPSN cryptographically pseudonymized under GDPR Article 4(5).'",
    ),
]


def findings(*areas: str) -> str:
    """One row per claim and area, with the citation of the area."""
    parts = []
    for area, flag, verdict, violation, observation in _CASES:
        if areas and area not in areas:
            continue
        scored = (
            "c.regulatory_section || ' (Similarity: ' || format('{:.1f}%', c.similarity_score * 100) || '): ' || c.excerpt"
        )
        plain = "c.regulatory_section || ': ' || c.excerpt"
        parts.append(f"""
    SELECT claim_id, '{area}' AS area, CASE WHEN {flag} THEN '{verdict}' ELSE 'COMPLIANT' END AS verdict,
      c.regulatory_section, CASE WHEN {flag} AND '{verdict}' = 'BREACH' THEN {scored} ELSE {plain} END
        AS statutory_citation,
      CASE WHEN {flag} THEN {violation} ELSE {observation} END AS observation, c.similarity_score
    FROM judged JOIN citations c ON c.area = '{area}'""")
    return "\n    UNION ALL".join(parts)
