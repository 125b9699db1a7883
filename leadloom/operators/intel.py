"""Text intelligence on companies: growth signals, pain points, competitors, technology insights, and scores from them.

Texts are put in long form first (one row per company and source); a type's patterns run only on rows that its joint pattern
hits, then each pattern by itself, so overlapping patterns all report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import saved
from ..functions.rules import any_in, first_of, hits_in, text
from .scoring import with_columns

#: Fixed values. Per signal type: patterns, confidence (with the word that raises it, if any) and impact.
GROWTH = {
    "hiring": ((r"hiring\s+\d+", r"\d+\s+new\s+hires?", r"expanding\s+team", r"job\s+openings?", r"we[']re\s+hiring", r"join\s+our\s+team", r"career\s+opportunities", r"talent\s+acquisition", r"headcount\s+growth", r"recruiting"), 0.6, ("hiring", 0.7), 0.6),
    "funding": ((r"series\s+[a-z]\s+funding", r"\$\d+[mk]?\s+raised?", r"investment\s+round", r"venture\s+capital", r"seed\s+funding", r"angel\s+investment", r"ipo\s+filing", r"public\s+offering", r"funding\s+announcement", r"capital\s+raise"), 0.7, ("funding", 0.8), 0.8),
    "expansion": ((r"new\s+office", r"expanding\s+to", r"international\s+expansion", r"global\s+presence", r"new\s+location", r"opening\s+in", r"market\s+expansion", r"geographic\s+growth"), 0.7, None, 0.7),
    "new_product": ((r"new\s+product", r"product\s+launch", r"feature\s+release", r"beta\s+launch", r"coming\s+soon", r"product\s+update", r"innovation", r"breakthrough", r"next\s+generation"), 0.6, None, 0.5),
    "partnership": ((r"partnership\s+with", r"strategic\s+alliance", r"collaboration", r"joint\s+venture", r"integration\s+with", r"partner\s+with", r"ecosystem\s+partner", r"technology\s+partner"), 0.7, None, 0.6),
    "acquisition": ((r"acquired\s+by", r"acquisition\s+of", r"merger\s+with", r"bought\s+by", r"purchased\s+by", r"takeover", r"consolidation", r"strategic\s+acquisition"), 0.8, None, 0.7),
}
GROWTH_NOTES = {
    "hiring": "Hiring activity detected", "funding": "Funding activity detected", "expansion": "Expansion activity detected", "new_product": "Product development detected",
    "partnership": "Partnership activity detected", "acquisition": "Acquisition activity detected",
}
#: Fixed values. Per category: patterns, confidence, severity, urgency, solutions.
PAIN = {
    "scaling": ((r"scaling\s+challenges?", r"growth\s+pains?", r"capacity\s+issues?", r"infrastructure\s+limitations?", r"performance\s+bottlenecks?", r"resource\s+constraints?", r"scalability\s+concerns?"), 0.7, 0.7, 0.6, ("Cloud infrastructure scaling", "Microservices architecture", "Load balancing solutions", "Performance optimization")),
    "technology": ((r"legacy\s+systems?", r"technical\s+debt", r"outdated\s+technology", r"system\s+integration", r"modernization", r"digital\s+transformation", r"technology\s+upgrade", r"platform\s+migration"), 0.8, 0.6, 0.5, ("Technology modernization", "System migration", "API development", "Digital transformation strategy")),
    "security": ((r"security\s+concerns?", r"data\s+breach", r"cybersecurity", r"compliance\s+issues?", r"privacy\s+concerns?", r"vulnerability", r"security\s+audit", r"penetration\s+testing"), 0.8, 0.8, 0.7, ("Security audit", "Penetration testing", "Compliance framework", "Security training")),
    "integration": ((r"integration\s+challenges?", r"data\s+silos?", r"system\s+fragmentation", r"api\s+limitations?", r"connectivity\s+issues?", r"interoperability", r"data\s+synchronization", r"workflow\s+automation"), 0.7, 0.6, 0.6, ("API integration platform", "Data pipeline automation", "Middleware solutions", "System integration strategy")),
    "performance": ((r"performance\s+issues?", r"slow\s+response", r"downtime", r"latency\s+problems?", r"system\s+crashes?", r"reliability\s+concerns?", r"uptime\s+challenges?", r"load\s+balancing"), 0.7, 0.7, 0.8, ("Performance monitoring", "Code optimization", "Infrastructure scaling", "Caching solutions")),
    "cost_optimization": ((r"cost\s+optimization", r"budget\s+constraints?", r"expensive\s+infrastructure", r"operational\s+costs?", r"resource\s+efficiency", r"cost\s+reduction", r"roi\s+concerns?", r"financial\s+pressure"), 0.6, 0.5, 0.6, ("Cost optimization audit", "Resource efficiency analysis", "Cloud cost management", "Process automation")),
    "talent_acquisition": ((r"talent\s+shortage", r"hiring\s+challenges?", r"skill\s+gaps?", r"recruitment\s+difficulties", r"retention\s+issues?", r"training\s+needs?", r"expertise\s+gaps?", r"team\s+building"), 0.7, 0.6, 0.5, ("Recruitment strategy", "Training programs", "Talent retention initiatives", "Skills development")),
    "data_management": ((r"data\s+quality", r"data\s+governance", r"data\s+management", r"analytics\s+challenges?", r"reporting\s+issues?", r"data\s+visualization", r"business\s+intelligence", r"data\s+strategy"), 0.7, 0.6, 0.5, ("Data governance framework", "Analytics platform", "Data quality tools", "Business intelligence solution")),
}
PAIN_NOTES = {
    "scaling": "Scaling challenge identified", "technology": "Technology challenge identified", "security": "Security concern identified", "integration": "Integration challenge identified",
    "performance": "Performance issue identified", "cost_optimization": "Cost concern identified", "talent_acquisition": "Talent challenge identified", "data_management": "Data challenge identified",
}
LEGACY_SOLUTIONS = ("Technology modernization roadmap", "Gradual migration strategy", "Modern framework adoption")
SIZE_SOLUTIONS = ("Process standardization", "Infrastructure scaling", "Team structure optimization")
#: Word lists of technologies, competitors, risks and alternatives.
MODERN = ("kubernetes", "docker", "microservices", "serverless", "machine learning", "ai", "blockchain", "cloud native", "react", "vue", "angular", "node.js", "python", "go", "tensorflow", "pytorch", "aws", "azure", "gcp")
LEGACY = ("jquery", "php", "mysql", "apache", "windows server", "internet explorer", "flash", "silverlight", "asp.net")
COMPETITOR_WORDS = ("competitor", "alternative", "vs", "versus", "compared to", "similar to", "like", "rival", "competing", "market leader")
INDIRECT = ("alternative", "similar to", "like")
LEADER = ("market leader", "industry leader", "leading", "#1", "number one", "dominant", "largest", "biggest", "top player")
CHALLENGER = ("challenger", "growing", "emerging", "rising", "up-and-coming", "fast-growing", "disruptor", "innovative")
MATURITY = {
    "emerging": ("webassembly", "deno", "svelte", "rust", "edge computing"), "growing": ("kubernetes", "docker", "graphql", "typescript", "vue.js"), "mature": ("react", "node.js", "python", "aws", "postgresql"),
    "declining": ("angular.js", "backbone.js", "coffeescript"), "legacy": ("jquery", "flash", "silverlight", "internet explorer"),
}
RISKS = {"flash": 1.0, "silverlight": 1.0, "internet explorer": 0.9, "jquery": 0.3, "php": 0.2, "mysql": 0.1}
ADVANTAGES = {"machine learning": 0.9, "artificial intelligence": 0.9, "kubernetes": 0.8, "microservices": 0.8, "serverless": 0.7, "graphql": 0.7, "typescript": 0.6, "react": 0.6}
ALTERNATIVES = {
    "react": ("vue.js", "angular", "svelte"), "angular": ("react", "vue.js"), "vue.js": ("react", "angular"), "mysql": ("postgresql", "mongodb"), "postgresql": ("mysql", "mongodb"),
    "aws": ("azure", "gcp"), "azure": ("aws", "gcp"), "gcp": ("aws", "azure"),
}
CATEGORIES = (
    ("frontend", ("react", "vue", "angular", "javascript", "html", "css")), ("backend", ("node.js", "python", "java", "go", "rust")), ("database", ("mysql", "postgresql", "mongodb", "redis")),
    ("cloud", ("aws", "azure", "gcp", "kubernetes", "docker")), ("analytics", ("google analytics", "mixpanel", "amplitude")), ("marketing", ("hubspot", "salesforce", "mailchimp")),
)
SOURCES = (("description", "company_description"), ("about", "about_section"), ("news", "news_articles"), ("press_releases", "press_releases"), ("recent_updates", "recent_updates"))

# ---- technology rules over ``tech`` (lower case, trimmed)

TECH_RULES = {
    "maturity": first_of([(f"tech IN ({', '.join(map(text, names))})", text(m)) for m, names in MATURITY.items()], "'mature'"),
    "adoption_trend": first_of([(any_in("tech", ("rust", "deno", "svelte", "webassembly")), "'increasing'"), (any_in("tech", ("jquery", "angular.js", "backbone.js", "flash")), "'decreasing'")], "'stable'"),
    "market_penetration": f"CAST({first_of([(any_in('tech', ('javascript', 'html', 'css', 'react', 'node.js')), '0.8'), (any_in('tech', ('python', 'java', 'aws', 'docker')), '0.5')], '0.2')} AS DOUBLE)",
    "competitive_advantage": f"CAST({first_of([(f'tech = {text(k)}', str(v)) for k, v in ADVANTAGES.items()], '0.3')} AS DOUBLE)",
    "risk_level": f"CAST({first_of([(f'tech = {text(k)}', str(v)) for k, v in RISKS.items()], '0.1')} AS DOUBLE)",
    "alternatives": first_of([(f"tech = {text(k)}", text(",".join(v))) for k, v in ALTERNATIVES.items()], "''"),
    "integration_complexity": f"CAST({first_of([(any_in('tech', ('kubernetes', 'microservices', 'machine learning')), '0.8'), (any_in('tech', ('react', 'vue.js', 'express')), '0.3')], '0.5')} AS DOUBLE)",
    "category": first_of([(any_in("tech", words), text(c)) for c, words in CATEGORIES], "'other'"),
}


def _texts(companies: DataFrame) -> DataFrame:
    """``(company_id, source, text)`` of the non-empty text sources, lower case."""
    c = with_columns(companies, about="string", news="array<string>", press_releases="array<string>", recent_updates="string")
    value = lambda n: F.array_join(n, " ") if dict(c.dtypes)[n].startswith("array") else F.col(n)
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lower(value(n)).alias("text")) for n, s in SOURCES])
    return c.select(F.col("id").alias("company_id"), F.inline(rows)).where("text is not null and text <> ''")


def _tagged(kind: str, name: str):
    return lambda m: F.struct(F.lit(kind).alias(name), m.alias("match"))


def _mention(word: int, relationship: str):
    return lambda m, i: F.struct(F.lit(word).alias("word"), i.alias("nth"), F.lit(relationship).alias("relationship"), F.trim(m).alias("name"))


def _found(companies: DataFrame, groups: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    """``(company_id, source, <name>, match)``, one row per match of each pattern."""
    t = F.col("text")
    per = []
    for kind, patterns in groups.items():
        each = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in patterns])
        hit = F.when(t.rlike("|".join(f"(?:{p})" for p in patterns)), each)
        per.append(F.transform(F.coalesce(hit, F.array().cast("array<string>")), _tagged(kind, name)))
    return _texts(companies).select("company_id", "source", F.inline(F.concat(*per)))


def _of(column: str, values: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(F.col(column) == kv[0], F.lit(float(kv[1]))), values.items(), F.when(F.lit(False), 0.0))


def _noted(notes: dict[str, str], kind: str) -> Column:
    return F.concat(F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])[F.col(kind)], F.lit(": "), F.col("match"))


def growth_signals_text(companies: DataFrame) -> DataFrame:
    """``(company_id, signal_type, description, confidence, impact_score, source, evidence)`` per match."""
    rows = _found(companies, {k: v[0] for k, v in GROWTH.items()}, "signal_type")
    raised = reduce(lambda c, kv: c.when((F.col("signal_type") == kv[0]) & F.contains(F.col("match"), F.lit(kv[1][2][0])), F.lit(kv[1][2][1])), [kv for kv in GROWTH.items() if kv[1][2]], F.when(F.lit(False), 0.0))
    confidence = F.coalesce(raised, _of("signal_type", {k: v[1] for k, v in GROWTH.items()}))
    return rows.select("company_id", "signal_type", _noted(GROWTH_NOTES, "signal_type").alias("description"), confidence.alias("confidence"), _of("signal_type", {k: v[3] for k, v in GROWTH.items()}).alias("impact_score"), "source", F.array("match").alias("evidence"))


def growth_team(companies: DataFrame) -> DataFrame:
    """Employee growth of more than 10 %."""
    now, before = F.col("employee_count"), F.col("previous_employee_count")
    rate = (now - before) / before
    rows = companies.where((now > 0) & (before > 0)).withColumn("rate", rate).where("rate > 0.1")
    percent = F.format_string("%.1f%%", F.bround(F.col("rate") * 100, 1))
    note = F.concat(F.lit("Employee growth: "), before.cast("string"), F.lit(" to "), now.cast("string"), F.lit(" ("), percent, F.lit(")"))
    return rows.select(F.col("id").alias("company_id"), F.lit("team_growth").alias("signal_type"), note.alias("description"), F.lit(0.9).alias("confidence"), F.round(F.least("rate", F.lit(1.0)), 6).alias("impact_score"), F.lit("employee_data").alias("source"), F.array(F.concat(F.lit("Employee count increased by "), percent)).alias("evidence"))


def _tech_hits(companies: DataFrame, words: tuple[str, ...]) -> DataFrame:
    c = companies.withColumn("tech_text", F.array_join("technologies", " "))
    return c.select(F.col("id").alias("company_id"), F.expr(hits_in("tech_text", words)).alias("n"))


def growth_tech(companies: DataFrame) -> DataFrame:
    """Three modern technologies or more."""
    rows = _tech_hits(companies, MODERN).where("n >= 3")
    n = F.col("n").cast("string")
    note, found = F.concat(F.lit("Modern technology adoption detected ("), n, F.lit(" technologies)")), F.concat(F.lit("Uses "), n, F.lit(" modern technologies"))
    return rows.select("company_id", F.lit("technology_upgrade").alias("signal_type"), note.alias("description"), F.lit(0.6).alias("confidence"), F.round(F.least(F.col("n") / 10.0, F.lit(1.0)), 6).alias("impact_score"), F.lit("technology_stack").alias("source"), F.array(found).alias("evidence"))


def growth_signals(companies: DataFrame, signal_type: str | None = None) -> DataFrame:
    """All growth signals with the company's name; of one type if given."""
    rows = growth_signals_text(companies).unionByName(growth_team(companies)).unionByName(growth_tech(companies))
    rows = rows.where(F.col("signal_type") == signal_type) if signal_type else rows
    return rows.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")


def _pain(rows: DataFrame, note: Column, keywords: Column, solutions: Column) -> DataFrame:
    rows = rows.withColumns({"description": note, "keywords": keywords, "potential_solutions": solutions})
    return rows.select("company_id", "category", "description", "confidence", "severity", "urgency", "source", "keywords", "potential_solutions")


def pain_points_text(companies: DataFrame) -> DataFrame:
    rows = _found(companies, {k: v[0] for k, v in PAIN.items()}, "category")
    rows = rows.withColumns({n: _of("category", {k: v[i] for k, v in PAIN.items()}) for i, n in ((1, "confidence"), (2, "severity"), (3, "urgency"))})
    solutions = reduce(lambda c, kv: c.when(F.col("category") == kv[0], F.array(*map(F.lit, kv[1][4]))), PAIN.items(), F.when(F.lit(False), F.array(F.lit(""))))
    return _pain(rows, _noted(PAIN_NOTES, "category"), F.array("match"), solutions)


def pain_legacy(companies: DataFrame) -> DataFrame:
    """Two legacy technologies or more."""
    rows = _tech_hits(companies, LEGACY).where("n >= 2").withColumns({"category": F.lit("technology"), "confidence": F.lit(0.6), "severity": F.lit(0.5), "urgency": F.lit(0.4), "source": F.lit("technology_analysis")})
    found = F.concat(F.col("n").cast("string"), F.lit(" legacy technologies"))
    return _pain(rows, F.concat(F.lit("Legacy technology stack detected ("), found, F.lit(")")), F.array(found), F.array(*map(F.lit, LEGACY_SOLUTIONS)))


def pain_size(companies: DataFrame) -> DataFrame:
    """50 to 200 employees."""
    rows = companies.where(F.col("employee_count").between(50, 200)).select(F.col("id").alias("company_id"), F.lit("scaling").alias("category"), F.lit(0.5).alias("confidence"), F.lit(0.6).alias("severity"), F.lit(0.5).alias("urgency"), F.lit("size_analysis").alias("source"))
    return _pain(rows, F.lit("Mid-size company scaling challenges"), F.array(F.lit("scaling"), F.lit("growth")), F.array(*map(F.lit, SIZE_SOLUTIONS)))


def pain_points(companies: DataFrame, category: str | None = None) -> DataFrame:
    rows = pain_points_text(companies).unionByName(pain_legacy(companies)).unionByName(pain_size(companies))
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")


def ranked_signals(signals: DataFrame, limit: int) -> DataFrame:
    """Highest confidence times impact first."""
    return signals.withColumn("rank_score", F.round(F.col("confidence") * F.col("impact_score"), 6)).orderBy(F.desc("rank_score"), "company_id", "signal_type", "description").limit(limit)


def ranked_pain_points(pains: DataFrame, limit: int) -> DataFrame:
    return pains.withColumn("rank_score", F.round(F.col("severity") * F.col("urgency"), 6)).orderBy(F.desc("rank_score"), "company_id", "category", "description").limit(limit)


def competitors(companies: DataFrame) -> DataFrame:
    """``(company_id, name, relationship, market_position, confidence, source)``: names after a competitor word, one row per name.

    The position is read from 50 characters on either side of the name's first place in the text; of several mentions the
    last position other than follower stays, and the first relationship.
    """
    c = with_columns(companies, about="string", news="array<string>", competitive_analysis="string")
    value = lambda n: F.array_join(n, " ") if dict(c.dtypes)[n].startswith("array") else F.col(n)
    names = (("description", "company_description"), ("about", "about_section"), ("news", "news_articles"), ("competitive_analysis", "competitive_analysis"))
    rows = c.select(F.col("id").alias("company_id"), F.posexplode(F.array(*[F.struct(F.lit(s).alias("source"), value(n).alias("text")) for n, s in names])).alias("at", "x")).select("company_id", "at", "x.*").where("text is not null and text <> ''")
    per = [
        F.transform(F.regexp_extract_all("text", F.lit(rf"(?i){w}\s+([A-Z][a-zA-Z\s]+?)(?:\s|\.|,|$)"), F.lit(1)), _mention(k, "indirect_competitor" if w in INDIRECT else "direct_competitor"))
        for k, w in enumerate(COMPETITOR_WORDS)
    ]
    rows = rows.select("company_id", "at", "source", "text", F.inline(F.concat(*per))).where(F.length("name").between(3, 49))
    spot = F.expr("locate(lower(name), lower(text))")
    around = F.lower(F.expr("substring(text, greatest(locate(lower(name), lower(text)) - 50, 1), locate(lower(name), lower(text)) + length(name) + 50 - greatest(locate(lower(name), lower(text)) - 50, 1))"))
    rows = rows.withColumn("around", F.when(spot > 0, around).otherwise(""))
    position = F.expr(first_of([(any_in("around", LEADER), "'leader'"), (any_in("around", CHALLENGER), "'challenger'")], "'follower'"))
    rows = rows.withColumn("position", position)
    order = F.struct("at", "word", "nth")
    told = F.when(F.col("position") != "follower", F.col("position"))
    merged = rows.groupBy("company_id", F.lower("name").alias("key")).agg(F.min_by("name", order).alias("name"), F.min_by("relationship", order).alias("relationship"), F.coalesce(F.max_by(told, F.when(told.isNotNull(), order)), F.lit("follower")).alias("market_position"), F.min_by("source", order).alias("source"))
    return merged.select("company_id", "name", "relationship", "market_position", F.lit(0.6).alias("confidence"), "source")


def technology_insights(companies: DataFrame) -> DataFrame:
    """Per company and technology: category, maturity, trend, penetration, advantage, risk, alternatives, complexity."""
    rows = companies.select(F.col("id").alias("company_id"), F.explode("technologies").alias("technology")).withColumn("tech", F.lower(F.trim("technology")))
    out = rows.withColumns({n: F.expr(sql) for n, sql in TECH_RULES.items()}).drop("tech")
    return out.withColumn("alternatives", F.filter(F.split("alternatives", ","), lambda x: x != ""))


def _mean(df: DataFrame, value: str, name: str) -> DataFrame:
    """``(company_id, name)``: mean of an expression per company, by exact sums."""
    total = F.sum(F.expr(value).cast("decimal(24,9)")).cast("double") / F.count("*")
    return df.groupBy("company_id").agg(F.least(F.round(total, 9), F.lit(1.0)).alias(name))


def growth_score(signals: DataFrame) -> DataFrame:
    """``(company_id, score)``: mean of confidence times impact."""
    return _mean(signals, "confidence * impact_score", "score")


def _joined(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "company_id", "full"), frames)


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0.0))


def opportunity_score(signals: DataFrame, pains: DataFrame) -> DataFrame:
    both = _joined(_mean(signals, "confidence * impact_score", "g"), _mean(pains, "severity * confidence", "p"))
    return both.select("company_id", F.round(_zero("g") * 0.7 + _zero("p") * 0.3, 6).alias("score"))


def risk_score(pains: DataFrame, insights: DataFrame) -> DataFrame:
    both = _joined(_mean(pains, "severity * urgency * confidence", "p"), _mean(insights, "risk_level", "t"))
    return both.select("company_id", F.round(_zero("p") * 0.6 + _zero("t") * 0.4, 6).alias("score"))


def intelligence_confidence(signals: DataFrame, pains: DataFrame, rivals: DataFrame) -> DataFrame:
    """Weighted mean confidence over the parts that exist (.4, .3, .3)."""
    all_ = _joined(_mean(signals, "confidence", "g"), _mean(pains, "confidence", "p"), _mean(rivals, "confidence", "c"))
    weight = lambda c, w: F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    total = weight("g", 0.4) + weight("p", 0.3) + weight("c", 0.3)
    return all_.select("company_id", F.round((_zero("g") * weight("g", 0.4) + _zero("p") * weight("p", 0.3) + _zero("c") * weight("c", 0.3)) / total, 6).alias("score"))


def recommendations(signals: DataFrame, pains: DataFrame, insights: DataFrame, rivals: DataFrame) -> DataFrame:
    """``(company_id, recommendations)``: ordered rules, the first five that hold."""
    has = lambda test: F.max(F.expr(test).cast("int"))
    s = signals.groupBy("company_id").agg(*[has(f"signal_type = '{k}'").alias(k) for k in ("hiring", "funding", "expansion")])
    p = pains.groupBy("company_id").agg(*[has(f"category = '{k}'").alias(k) for k in ("technology", "scaling", "security")])
    t = insights.groupBy("company_id").agg(has("risk_level > 0.7").alias("risky"), has("maturity = 'emerging'").alias("emerging"))
    c = rivals.groupBy("company_id").agg(has("market_position = 'leader'").alias("leader"))
    rules = (
        ("hiring", "Consider talent acquisition solutions and HR technology"), ("funding", "Explore growth acceleration and scaling solutions"), ("expansion", "Focus on infrastructure and operational scaling"),
        ("technology", "Prioritize technology modernization initiatives"), ("scaling", "Implement scalable infrastructure and processes"), ("security", "Address security vulnerabilities and compliance gaps"),
        ("risky", "Consider migrating from high-risk legacy technologies"), ("emerging", "Monitor emerging technology adoption for competitive advantage"), ("leader", "Analyze market leaders for competitive positioning opportunities"),
    )
    tips = F.slice(F.array_compact(F.array(*[F.when(F.col(k) == 1, tip) for k, tip in rules])), 1, 5)
    return _joined(s, p, t, c).select("company_id", tips.alias("recommendations"))


def company_intelligence(companies: DataFrame) -> DataFrame:
    """One row per company: counts, growth, opportunity and risk score, confidence and recommendations."""
    made = (growth_signals(companies), pain_points(companies), technology_insights(companies), competitors(companies))
    signals, pains, insights, rivals = (saved(df, "intel") for df in made)  # each is read by several of the parts below
    count = lambda df, n: df.groupBy("company_id").agg(F.count("*").alias(n))
    parts = [
        count(signals, "n_signals"), count(pains, "n_pain_points"), count(rivals, "n_competitors"), count(insights, "n_technologies"), growth_score(signals).withColumnRenamed("score", "growth_score"),
        opportunity_score(signals, pains).withColumnRenamed("score", "opportunity_score"), risk_score(pains, insights).withColumnRenamed("score", "risk_score"), intelligence_confidence(signals, pains, rivals).withColumnRenamed("score", "confidence"),
        recommendations(signals, pains, insights, rivals),
    ]
    out = reduce(lambda a, b: a.join(b, "company_id", "left"), parts, companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")))
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_signals", "n_pain_points", "n_competitors", "n_technologies")} | {n: F.coalesce(n, F.lit(0.0)) for n in ("growth_score", "opportunity_score", "risk_score", "confidence")})
    return out.withColumn("recommendations", F.coalesce("recommendations", F.array().cast("array<string>")))


def _avg(c: str) -> Column:
    return F.round(F.sum(F.col(c).cast("decimal(24,6)")).cast("double") / F.count("*"), 6)


def intelligence_summary(intel: DataFrame) -> DataFrame:
    return intel.agg(F.count("*").alias("companies"), *[_avg(c).alias(f"mean_{c}") for c in ("growth_score", "opportunity_score", "risk_score", "confidence")], *[F.sum(c).alias(f"total_{c[2:]}") for c in ("n_signals", "n_pain_points", "n_competitors")])


def intelligence_report(intel: DataFrame) -> DataFrame:
    """High growth and opportunity from 80 %, high risk from 80 %, low under 30 %, scores in hundredths."""
    at = lambda c, n: F.count_if(F.col(c) * 100 >= n)
    return intel.agg(F.count("*").alias("companies"), at("growth_score", 80).alias("high_growth"), at("opportunity_score", 80).alias("high_opportunity"), at("risk_score", 80).alias("high_risk"), F.count_if(F.col("growth_score") * 100 < 30).alias("low_growth"), F.count_if(F.col("risk_score") * 100 < 30).alias("low_risk"))
