"""Queries: text intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import any_in, first_of, hits_in
from ..operators import analytics as A
from ..operators import intel as I
from .registry import query


def _q(p: str) -> str:
    return p.replace("'", "''")


_NOTES = {
    "hiring": "Hiring activity detected", "funding": "Funding activity detected", "expansion": "Expansion activity detected", "new_product": "Product development detected", "partnership": "Partnership activity detected", "acquisition": "Acquisition activity detected",
    "scaling": "Scaling challenge identified", "technology": "Technology challenge identified", "security": "Security concern identified", "integration": "Integration challenge identified", "performance": "Performance issue identified",
    "cost_optimization": "Cost concern identified", "talent_acquisition": "Talent challenge identified", "data_management": "Data challenge identified",
}


def _growth_sql() -> str:
    parts = []
    for kind, (patterns, base, raised, impact) in I.GROWTH.items():
        confidence = f"CASE WHEN contains(m, '{raised[0]}') THEN {raised[1]} ELSE {base} END" if raised else str(base)
        parts += [f"SELECT id AS company_id, '{kind}' AS signal_type, '{_NOTES[kind]}: ' || m AS description, CAST({confidence} AS DOUBLE) AS confidence, CAST({impact} AS DOUBLE) AS impact_score, 'company_description' AS source FROM (SELECT id, unnest(regexp_extract_all(lower(description), '{_q(p)}')) AS m FROM companies)" for p in patterns]
    return " UNION ALL ".join(parts)


def _pain_sql() -> str:
    parts = []
    for kind, (patterns, c, s, u, _) in I.PAIN.items():
        parts += [f"SELECT id AS company_id, '{kind}' AS category, '{_NOTES[kind]}: ' || m AS description, CAST({c} AS DOUBLE) AS confidence, CAST({s} AS DOUBLE) AS severity, CAST({u} AS DOUBLE) AS urgency, 'company_description' AS source FROM (SELECT id, unnest(regexp_extract_all(lower(description), '{_q(p)}')) AS m FROM companies)" for p in patterns]
    return " UNION ALL ".join(parts)


_TT = "coalesce(replace(technologies_csv, ',', ' '), '')"
TEAM = "SELECT id AS company_id, 'team_growth' AS signal_type, concat('Employee growth: ', previous_employee_count, ' to ', employee_count, printf(' (%.1f%%)', round_even(100.0::DOUBLE * ((employee_count - previous_employee_count) / CAST(previous_employee_count AS DOUBLE)), 1))) AS description, 0.9::DOUBLE AS confidence, round(least((employee_count - previous_employee_count) / CAST(previous_employee_count AS DOUBLE), 1.0), 6) AS impact_score, 'employee_data' AS source FROM companies WHERE employee_count > 0 AND previous_employee_count > 0 AND (employee_count - previous_employee_count) / CAST(previous_employee_count AS DOUBLE) > 0.1"
TECH = f"SELECT id AS company_id, 'technology_upgrade' AS signal_type, concat('Modern technology adoption detected (', n, ' technologies)') AS description, 0.6::DOUBLE AS confidence, round(least(n / 10.0::DOUBLE, 1.0), 6) AS impact_score, 'technology_stack' AS source FROM (SELECT id, {hits_in(_TT, I.MODERN)} AS n FROM companies) WHERE n >= 3"
LEGACY = f"SELECT id AS company_id, 'technology' AS category, concat('Legacy technology stack detected (', n, ' legacy technologies)') AS description, 0.6::DOUBLE AS confidence, 0.5::DOUBLE AS severity, 0.4::DOUBLE AS urgency, 'technology_analysis' AS source FROM (SELECT id, {hits_in(_TT, I.LEGACY)} AS n FROM companies) WHERE n >= 2"
SIZE = "SELECT id AS company_id, 'scaling' AS category, 'Mid-size company scaling challenges' AS description, 0.5::DOUBLE AS confidence, 0.6::DOUBLE AS severity, 0.5::DOUBLE AS urgency, 'size_analysis' AS source FROM companies WHERE employee_count BETWEEN 50 AND 200"
SIGNALS = f"g AS ({_growth_sql()} UNION ALL {TEAM} UNION ALL {TECH})"
PAINS = f"p AS ({_pain_sql()} UNION ALL {LEGACY} UNION ALL {SIZE})"
INSIGHTS = "x AS (SELECT id AS company_id, unnest(string_split(technologies_csv, ',')) AS technology FROM companies), i AS (SELECT company_id, technology, " + ", ".join(f"{sql} AS {n}" for n, sql in I.TECH_RULES.items()) + " FROM (SELECT *, lower(trim(technology)) AS tech FROM x))"
S, P = ("company_id", "signal_type", "description", "confidence", "impact_score", "source"), ("company_id", "category", "description", "confidence", "severity", "urgency", "source")


@query("growth_signals_text", _growth_sql(), "companies")
def _(t):
    return I.growth_signals_text(t.companies).select(*S)


@query("growth_team", f"SELECT *, 'Employee count increased by ' || regexp_extract(description, '[(]([^)]*)[)]', 1) AS evidence FROM ({TEAM})", "companies")
def _(t):
    return I.growth_team(t.companies).select(*S, F.array_join("evidence", ",").alias("evidence"))


@query("growth_tech", TECH, "companies")
def _(t):
    return I.growth_tech(t.companies).select(*S)


@query("growth_signals", f"WITH {SIGNALS} SELECT g.*, name AS company_name FROM g JOIN companies ON id = company_id", "companies")
def _(t):
    return I.growth_signals(t.companies).select(*S, "company_name")


@query("pain_points_text", _pain_sql(), "companies")
def _(t):
    return I.pain_points_text(t.companies).select(*P)


def _lists(df):
    return df.select(*P, *[F.array_join(c, ", ").alias(c) for c in ("keywords", "potential_solutions")])


@query("pain_legacy", f"SELECT *, regexp_extract(description, '[(]([^)]*)[)]', 1) AS keywords, 'Technology modernization roadmap, Gradual migration strategy, Modern framework adoption' AS potential_solutions FROM ({LEGACY})", "companies")
def _(t):
    return _lists(I.pain_legacy(t.companies))


@query("pain_size", f"SELECT *, 'scaling, growth' AS keywords, 'Process standardization, Infrastructure scaling, Team structure optimization' AS potential_solutions FROM ({SIZE})", "companies")
def _(t):
    return _lists(I.pain_size(t.companies))


@query("pain_points", f"WITH {PAINS} SELECT p.*, name AS company_name FROM p JOIN companies ON id = company_id", "companies")
def _(t):
    return I.pain_points(t.companies).select(*P, "company_name")


@query("ranked_signals", f"WITH {SIGNALS} SELECT company_id, signal_type, round(confidence * impact_score, 6) AS rank_score FROM g ORDER BY 3 DESC, company_id, signal_type, description LIMIT 25", "companies")
def _(t):
    return I.ranked_signals(I.growth_signals(t.companies), 25).select("company_id", "signal_type", "rank_score")


@query("ranked_pain_points", f"WITH {PAINS} SELECT company_id, category, round(severity * urgency, 6) AS rank_score FROM p ORDER BY 3 DESC, company_id, category, description LIMIT 25", "companies")
def _(t):
    return I.ranked_pain_points(I.pain_points(t.companies), 25).select("company_id", "category", "rank_score")


_NEAR = "lower(substring(description, greatest(instr(lower(description), lower(name)) - 50, 1), instr(lower(description), lower(name)) + length(name) + 50 - greatest(instr(lower(description), lower(name)) - 50, 1)))"
_WORDS = " UNION ALL ".join(f"SELECT id, description, {k} AS word, '{'indirect_competitor' if w in I.INDIRECT else 'direct_competitor'}' AS relationship, trim(unnest(regexp_extract_all(description, '(?i){w}\\s+([A-Z][a-zA-Z\\s]+?)(?:\\s|\\.|,|$)', 1))) AS name FROM companies" for k, w in enumerate(I.COMPETITOR_WORDS))
RIVALS = f"""w AS ({_WORDS}), v AS (SELECT *, {_NEAR} AS around FROM w WHERE length(name) BETWEEN 3 AND 49), u AS (SELECT *, {first_of([(any_in('around', I.LEADER), "'leader'"), (any_in('around', I.CHALLENGER), "'challenger'")], "'follower'")} AS pos FROM v),
c AS (SELECT id AS company_id, arg_min(name, word) AS name, arg_min(relationship, word) AS relationship, coalesce(arg_max(pos, word) FILTER (pos <> 'follower'), 'follower') AS market_position, 0.6::DOUBLE AS confidence, 'company_description' AS source FROM u GROUP BY id, lower(name))"""


@query("competitors", f"WITH {RIVALS} SELECT * FROM c", "companies")
def _(t):
    return I.competitors(t.companies)


@query("competitive_summary", f"WITH {RIVALS}, n AS (SELECT company_id, count(*) n FROM c GROUP BY 1) SELECT id, coalesce(n, 0) AS competitors, CASE WHEN coalesce(n, 0) = 0 THEN 'open' WHEN n <= 2 THEN 'moderate' ELSE 'crowded' END AS position FROM companies LEFT JOIN n ON id = company_id", "companies")
def _(t):
    return A.competitive_summary(I.competitors(t.companies), t.companies)


@query("technology_insights", f"WITH {INSIGHTS} SELECT * FROM i", "companies")
def _(t):
    rows = I.technology_insights(t.companies)
    return rows.withColumn("alternatives", F.array_join("alternatives", ","))


def _mean(table: str, value: str, name: str) -> str:
    return f"(SELECT company_id, least(round(CAST(sum(CAST({value} AS DECIMAL(24,9))) AS DOUBLE) / count(*), 9), 1.0) AS {name} FROM {table} GROUP BY 1)"


G = _mean("g", "confidence * impact_score", "g")


@query("growth_score", f"WITH {SIGNALS} SELECT company_id, g AS score FROM {G}", "companies")
def _(t):
    return I.growth_score(I.growth_signals(t.companies))


_OPP = f"SELECT company_id, round(coalesce(g, 0) * 0.7::DOUBLE + coalesce(p, 0) * 0.3::DOUBLE, 6) AS score FROM {G} FULL JOIN {_mean('p', 'severity * confidence', 'p')} USING (company_id)"
_RISK = f"SELECT company_id, round(coalesce(p, 0) * 0.6::DOUBLE + coalesce(t, 0) * 0.4::DOUBLE, 6) AS score FROM {_mean('p', 'severity * urgency * confidence', 'p')} FULL JOIN {_mean('i', 'risk_level', 't')} USING (company_id)"
_CONF = f"""SELECT company_id, round((coalesce(g, 0) * 0.4::DOUBLE + coalesce(p, 0) * 0.3::DOUBLE + coalesce(c, 0) * 0.3::DOUBLE) / (CASE WHEN g IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN p IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END), 6) AS score
FROM {_mean('g', 'confidence', 'g')} FULL JOIN {_mean('p', 'confidence', 'p')} USING (company_id) FULL JOIN {_mean('c', 'confidence', 'c')} USING (company_id)"""


@query("opportunity_score", f"WITH {SIGNALS}, {PAINS} {_OPP}", "companies")
def _(t):
    return I.opportunity_score(I.growth_signals(t.companies), I.pain_points(t.companies))


@query("risk_score", f"WITH {PAINS}, {INSIGHTS} {_RISK}", "companies")
def _(t):
    return I.risk_score(I.pain_points(t.companies), I.technology_insights(t.companies))


@query("intelligence_confidence", f"WITH {SIGNALS}, {PAINS}, {RIVALS} {_CONF}", "companies")
def _(t):
    return I.intelligence_confidence(I.growth_signals(t.companies), I.pain_points(t.companies), I.competitors(t.companies))


_REC = """SELECT company_id, array_to_string(list_slice(list_filter([CASE WHEN hiring THEN 'Consider talent acquisition solutions and HR technology' END, CASE WHEN funding THEN 'Explore growth acceleration and scaling solutions' END, CASE WHEN expansion THEN 'Focus on infrastructure and operational scaling' END,
CASE WHEN technology THEN 'Prioritize technology modernization initiatives' END, CASE WHEN scaling THEN 'Implement scalable infrastructure and processes' END, CASE WHEN security THEN 'Address security vulnerabilities and compliance gaps' END, CASE WHEN risky THEN 'Consider migrating from high-risk legacy technologies' END,
CASE WHEN emerging THEN 'Monitor emerging technology adoption for competitive advantage' END, CASE WHEN leader THEN 'Analyze market leaders for competitive positioning opportunities' END], lambda x: x IS NOT NULL), 1, 5), ' | ') AS recommendations
FROM (SELECT company_id, bool_or(signal_type = 'hiring') hiring, bool_or(signal_type = 'funding') funding, bool_or(signal_type = 'expansion') expansion FROM g GROUP BY 1)
FULL JOIN (SELECT company_id, bool_or(category = 'technology') technology, bool_or(category = 'scaling') scaling, bool_or(category = 'security') security FROM p GROUP BY 1) USING (company_id)
FULL JOIN (SELECT company_id, bool_or(risk_level > 0.7) risky, bool_or(maturity = 'emerging') emerging FROM i GROUP BY 1) USING (company_id) FULL JOIN (SELECT company_id, bool_or(market_position = 'leader') leader FROM c GROUP BY 1) USING (company_id)"""


@query("recommendations", f"WITH {SIGNALS}, {PAINS}, {INSIGHTS}, {RIVALS} {_REC}", "companies")
def _(t):
    c = t.companies
    return I.recommendations(I.growth_signals(c), I.pain_points(c), I.technology_insights(c), I.competitors(c)).select("company_id", F.array_join("recommendations", " | ").alias("recommendations"))


_ALL = f"""WITH {SIGNALS}, {PAINS}, {INSIGHTS}, {RIVALS}, a AS (SELECT id AS company_id, coalesce((SELECT count(*) FROM g WHERE g.company_id = id), 0) AS n_signals, coalesce((SELECT count(*) FROM p WHERE p.company_id = id), 0) AS n_pain_points, coalesce((SELECT count(*) FROM c WHERE c.company_id = id), 0) AS n_competitors,
coalesce(gs.g, 0) AS growth_score, coalesce(o.score, 0) AS opportunity_score, coalesce(r.score, 0) AS risk_score, coalesce(f.score, 0) AS confidence FROM companies LEFT JOIN {G} gs ON gs.company_id = id LEFT JOIN ({_OPP}) o ON o.company_id = id LEFT JOIN ({_RISK}) r ON r.company_id = id LEFT JOIN ({_CONF}) f ON f.company_id = id)"""
_COLS = ("company_id", "n_signals", "n_pain_points", "n_competitors", "growth_score", "opportunity_score", "risk_score", "confidence")


@query("company_intelligence", f"{_ALL} SELECT {', '.join(_COLS)} FROM a", "companies")
def _(t):
    return I.company_intelligence(t.companies).select(*_COLS)


_M = "round(CAST(sum(CAST({0} AS DECIMAL(24,6))) AS DOUBLE) / count(*), 6) AS mean_{0}"


@query("intelligence_summary", f"{_ALL} SELECT count(*) AS companies, {', '.join(_M.format(c) for c in _COLS[4:])}, CAST(sum(n_signals) AS BIGINT) AS total_signals, CAST(sum(n_pain_points) AS BIGINT) AS total_pain_points, CAST(sum(n_competitors) AS BIGINT) AS total_competitors FROM a", "companies")
def _(t):
    return I.intelligence_summary(I.company_intelligence(t.companies))


@query("intelligence_report", f"{_ALL} SELECT count(*) AS companies, count(*) FILTER (growth_score * 100 >= 80) AS high_growth, count(*) FILTER (opportunity_score * 100 >= 80) AS high_opportunity, count(*) FILTER (risk_score * 100 >= 80) AS high_risk, count(*) FILTER (growth_score * 100 < 30) AS low_growth, count(*) FILTER (risk_score * 100 < 30) AS low_risk FROM a", "companies")
def _(t):
    return I.intelligence_report(I.company_intelligence(t.companies))


@query("engagement_opportunities", f"WITH {SIGNALS}, {PAINS} SELECT priority, count(*) AS leads FROM (SELECT CASE WHEN id IN (SELECT company_id FROM g) THEN 'high' WHEN id IN (SELECT company_id FROM p) THEN 'medium' WHEN technologies_csv IS NOT NULL THEN 'low' END AS priority FROM companies) WHERE priority IS NOT NULL GROUP BY 1", "companies")
def _(t):
    return A.engagement_opportunities(I.growth_signals(t.companies), I.pain_points(t.companies), t.companies)
