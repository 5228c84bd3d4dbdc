"""Technology mentions in tender texts: surfaces, requirement levels, versions, fit with a company's stack."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions.arrays import let, running_sums
from telar.functions.dictionary import dictionary_hits

# Surfaces, the names that they stand for, and categories.
SURFACES = [
    ("javascript", "JavaScript", "language"),
    ("js", "JavaScript", "language"),
    ("ecmascript", "JavaScript", "language"),
    ("typescript", "TypeScript", "language"),
    ("ts", "TypeScript", "language"),
    ("python", "Python", "language"),
    ("python3", "Python", "language"),
    ("python 3", "Python", "language"),
    ("py", "Python", "language"),
    ("java", "Java", "language"),
    ("openjdk", "Java", "language"),
    ("jdk", "Java", "language"),
    ("c#", "C#", "language"),
    ("csharp", "C#", "language"),
    ("golang", "Go", "language"),
    ("go lang", "Go", "language"),
    ("rust", "Rust", "language"),
    ("rustlang", "Rust", "language"),
    ("php", "PHP", "language"),
    ("ruby", "Ruby", "language"),
    ("nodejs", "Node.js", "framework"),
    ("node.js", "Node.js", "framework"),
    ("node", "Node.js", "framework"),
    ("react", "React", "framework"),
    ("reactjs", "React", "framework"),
    ("react.js", "React", "framework"),
    ("react js", "React", "framework"),
    ("vuejs", "Vue.js", "framework"),
    ("vue.js", "Vue.js", "framework"),
    ("vue", "Vue.js", "framework"),
    ("angular", "Angular", "framework"),
    ("angularjs", "AngularJS", "framework"),
    ("nextjs", "Next.js", "framework"),
    ("next.js", "Next.js", "framework"),
    ("nuxt", "Nuxt.js", "framework"),
    ("nuxtjs", "Nuxt.js", "framework"),
    ("express", "Express.js", "framework"),
    ("expressjs", "Express.js", "framework"),
    ("nestjs", "NestJS", "framework"),
    ("nest.js", "NestJS", "framework"),
    ("django", "Django", "framework"),
    ("flask", "Flask", "framework"),
    ("fastapi", "FastAPI", "framework"),
    ("pandas", "Pandas", "framework"),
    ("numpy", "NumPy", "framework"),
    ("tensorflow", "TensorFlow", "framework"),
    ("pytorch", "PyTorch", "framework"),
    ("scikit-learn", "scikit-learn", "framework"),
    ("sklearn", "scikit-learn", "framework"),
    ("celery", "Celery", "framework"),
    ("spring", "Spring Framework", "framework"),
    ("spring framework", "Spring Framework", "framework"),
    ("springboot", "Spring Boot", "framework"),
    ("spring boot", "Spring Boot", "framework"),
    ("spring-boot", "Spring Boot", "framework"),
    ("hibernate", "Hibernate", "framework"),
    (".net", ".NET", "framework"),
    ("dotnet", ".NET", "framework"),
    (".net core", ".NET Core", "framework"),
    ("asp.net", "ASP.NET", "framework"),
    ("aspnet", "ASP.NET", "framework"),
    ("blazor", "Blazor", "framework"),
    ("laravel", "Laravel", "framework"),
    ("symfony", "Symfony", "framework"),
    ("wordpress", "WordPress", "framework"),
    ("rails", "Ruby on Rails", "framework"),
    ("ruby on rails", "Ruby on Rails", "framework"),
    ("ror", "Ruby on Rails", "framework"),
    ("postgresql", "PostgreSQL", "database"),
    ("postgres", "PostgreSQL", "database"),
    ("pgsql", "PostgreSQL", "database"),
    ("mysql", "MySQL", "database"),
    ("mariadb", "MariaDB", "database"),
    ("oracle", "Oracle Database", "database"),
    ("oracle database", "Oracle Database", "database"),
    ("oracle db", "Oracle Database", "database"),
    ("sql server", "SQL Server", "database"),
    ("sqlserver", "SQL Server", "database"),
    ("mssql", "SQL Server", "database"),
    ("mongodb", "MongoDB", "database"),
    ("mongo", "MongoDB", "database"),
    ("redis", "Redis", "database"),
    ("elasticsearch", "Elasticsearch", "database"),
    ("elastic", "Elasticsearch", "database"),
    ("cassandra", "Cassandra", "database"),
    ("dynamodb", "DynamoDB", "database"),
    ("sqlite", "SQLite", "database"),
    ("couchdb", "CouchDB", "database"),
    ("neo4j", "Neo4j", "database"),
    ("aws", "AWS", "infrastructure"),
    ("amazon web services", "AWS", "infrastructure"),
    ("azure", "Microsoft Azure", "infrastructure"),
    ("microsoft azure", "Microsoft Azure", "infrastructure"),
    ("gcp", "Google Cloud Platform", "infrastructure"),
    ("google cloud", "Google Cloud Platform", "infrastructure"),
    ("google cloud platform", "Google Cloud Platform", "infrastructure"),
    ("digitalocean", "DigitalOcean", "infrastructure"),
    ("heroku", "Heroku", "infrastructure"),
    ("vercel", "Vercel", "infrastructure"),
    ("netlify", "Netlify", "infrastructure"),
    ("docker", "Docker", "infrastructure"),
    ("kubernetes", "Kubernetes", "infrastructure"),
    ("k8s", "Kubernetes", "infrastructure"),
    ("openshift", "OpenShift", "infrastructure"),
    ("terraform", "Terraform", "infrastructure"),
    ("ansible", "Ansible", "infrastructure"),
    ("jenkins", "Jenkins", "infrastructure"),
    ("gitlab ci", "GitLab CI", "infrastructure"),
    ("github actions", "GitHub Actions", "infrastructure"),
    ("circleci", "CircleCI", "infrastructure"),
    ("nginx", "NGINX", "infrastructure"),
    ("apache", "Apache HTTP Server", "infrastructure"),
    ("traefik", "Traefik", "infrastructure"),
    ("istio", "Istio", "infrastructure"),
    ("prometheus", "Prometheus", "infrastructure"),
    ("grafana", "Grafana", "infrastructure"),
    ("datadog", "Datadog", "infrastructure"),
    ("rabbitmq", "RabbitMQ", "infrastructure"),
    ("kafka", "Apache Kafka", "infrastructure"),
    ("apache kafka", "Apache Kafka", "infrastructure"),
    ("sqs", "Amazon SQS", "infrastructure"),
    ("activemq", "ActiveMQ", "infrastructure"),
    ("iso 27001", "ISO 27001", "security_cert"),
    ("iso27001", "ISO 27001", "security_cert"),
    ("iso 27002", "ISO 27002", "security_cert"),
    ("iso 9001", "ISO 9001", "security_cert"),
    ("iso9001", "ISO 9001", "security_cert"),
    ("soc2", "SOC 2", "security_cert"),
    ("soc 2", "SOC 2", "security_cert"),
    ("gdpr", "GDPR", "security_cert"),
    ("hipaa", "HIPAA", "security_cert"),
    ("pci dss", "PCI DSS", "security_cert"),
    ("pci-dss", "PCI DSS", "security_cert"),
    ("ens", "ENS", "security_cert"),
    ("cmmi", "CMMI", "security_cert"),
    ("oauth", "OAuth", "security_cert"),
    ("oauth2", "OAuth 2.0", "security_cert"),
    ("saml", "SAML", "security_cert"),
    ("ldap", "LDAP", "security_cert"),
    ("ssl", "SSL/TLS", "security_cert"),
    ("tls", "SSL/TLS", "security_cert"),
    ("agile", "Agile", "methodology"),
    ("scrum", "Scrum", "methodology"),
    ("kanban", "Kanban", "methodology"),
    ("devops", "DevOps", "methodology"),
    ("ci/cd", "CI/CD", "methodology"),
    ("cicd", "CI/CD", "methodology"),
    ("tdd", "TDD", "methodology"),
    ("bdd", "BDD", "methodology"),
    ("maven", "Maven", "tool"),
    ("gradle", "Gradle", "tool"),
    ("git", "Git", "tool"),
    ("github", "GitHub", "tool"),
    ("gitlab", "GitLab", "tool"),
    ("bitbucket", "Bitbucket", "tool"),
    ("jira", "Jira", "tool"),
    ("confluence", "Confluence", "tool"),
    ("slack", "Slack", "tool"),
    ("teams", "Microsoft Teams", "tool"),
    ("figma", "Figma", "tool"),
    ("postman", "Postman", "tool"),
    ("swagger", "Swagger/OpenAPI", "tool"),
    ("openapi", "Swagger/OpenAPI", "tool"),
]
# Words of each requirement level; one that is listed twice counts twice.
MUST = [
    "debe", "deberá", "deberan", "obligatorio", "obligatoria", "requerido", "requerida", "imprescindible", "indispensable", "excluyente",
    "necesario", "necesaria", "exigido", "exigida", "must", "shall", "required", "mandatory", "essential",
]
NICE = [
    "valorará", "valorara", "deseable", "preferible", "preferente", "opcional", "plus", "bonificará", "bonificara", "puntuará", "puntuara", "adicional",
    "ventaja", "bonus", "preferred", "bonus", "nice to have", "nice-to-have", "optional", "desirable", "advantage",
]
FORBIDDEN = [
    "no usar", "no utilizar", "prohibido", "prohibida", "evitar", "nunca", "migrar desde", "migrar de", "reemplazar", "sustituir", "legacy", "obsoleto",
    "obsoleta", "descartado", "descartada", "excluido", "excluida", "must not", "forbidden", "avoid", "migrate from", "replace", "deprecated", "legacy",
]
GO = r"(?iU)(?<!\w)(?:en\s+go|con\s+go|golang|go\s+lang|lenguaje\s+go|using\s+go|in\s+go|with\s+go)(?!\w)"
SIGNS = {"mandatory": "✅", "nice_to_have": "💡", "forbidden": "🚫"}


def pattern(strict: bool = False) -> str:
    """All surfaces as one pattern, the longest first; strict takes plain word boundaries, which `c#` and `.net` rarely meet."""
    every = "|".join(re.sub(r"([.#+/*?^$()\[\]{}|\\-])", r"\\\1", s) for s in sorted((s for s, *_ in SURFACES), key=lambda s: (-len(s), s)))
    return rf"(?iU)\b(?:{every})\b" if strict else rf"(?iU)(?<!\w)(?:{every})(?!\w)"


def hits(text: Column, regex: str) -> Column:
    """Array of (raw, offset) of all matches; an offset is the length of all gaps and matches up to and with its own, less its own."""
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    places = lambda f: F.zip_with(f, running_sums(F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda m, g: F.length(m) + F.length(g))), lambda m, end: F.struct(
        m.alias("raw"), (end - F.length(m)).cast("int").alias("offset")))
    return F.when(text.rlike(regex), let(found, places))


def mentions(texts: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """A row per hit: keys, raw, offset, text. One automaton finds all surfaces; strict, by a pattern with plain word boundaries."""
    found = hits(F.col("text"), pattern(True)) if strict else dictionary_hits(F.col("text"), [s for s, *_ in SURFACES])
    return texts.withColumn("h", found).select(*keys, "text", F.inline("h"))


def canonicalize(found: DataFrame) -> DataFrame:
    """Hits with name and category, by the broadcast dictionary (as many rows as there are surfaces)."""
    dictionary = found.sparkSession.createDataFrame(SURFACES, "surface string, name string, category string")
    return found.join(F.broadcast(dictionary), F.lower("raw") == F.col("surface")).drop("surface")


def go_mentions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The language Go, where its context names it; less certain."""
    out = texts.withColumn("h", hits(F.col("text"), GO)).select(*keys, "text", F.inline("h"))
    return out.withColumns({"name": F.lit("Go"), "category": F.lit("language"), "confidence": F.lit(0.85)})


def context_of(window: int = 50) -> Column:
    a = F.greatest(F.col("offset") - window, F.lit(0))
    return F.trim(F.substring(F.col("text"), a + 1, F.col("offset") + F.length("raw") + window - a))


def level_of(context: Column) -> Column:
    """forbidden, nice_to_have or mandatory, by words in the context's sentences; short sentences weigh more."""
    sentences = F.filter(F.transform(F.split(F.replace(F.lower(context), F.lit("\n"), F.lit(". ")), r"\."), lambda s: F.trim(s)), lambda s: s != "")

    def score(words: list[str], short: int) -> Column:
        weight = lambda s: F.when(F.size(F.split(s, r"\s+")) < short, 3).otherwise(1)
        count = lambda s: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: s.contains(w)))
        return F.aggregate(sentences, F.lit(0), lambda acc, s: acc + count(s) * weight(s))

    return F.when(score(FORBIDDEN, 15) >= 2, "forbidden").when(score(NICE, 20) >= 2, "nice_to_have").otherwise("mandatory")


def version_of(context: Column, name: Column) -> Column:
    """The version right after the name's first occurrence in the context, null if none."""
    at = F.position(F.lower(name), F.lower(context))
    area = F.substring(context, at + F.length(name), F.lit(15))
    found = F.regexp_extract(area, r"^\s*(\d+(?:\.\d+)*|[<>=!]+\s*\d+(?:\.\d+)*)", 1)
    return F.when((at > 0) & (found != ""), F.trim(found))


def entities(texts: DataFrame, keys: list[str], go: bool = True) -> DataFrame:
    """One row per text and name: the first hit, with context, level and version; Go by context only where it isn't named."""
    order = F.col("offset")
    named = canonicalize(mentions(texts, keys)).withColumn("confidence", F.lit(0.9))
    first = named.groupBy(*keys, "name", "category").agg(F.min_by(F.struct("raw", "offset", "text", "confidence"), order).alias("m"))
    out = first.select(*keys, "name", "category", "m.*")
    if go:
        extra = go_mentions(texts, keys).groupBy(*keys, "name", "category").agg(F.min_by(F.struct("raw", "offset", "text", "confidence"), order).alias("m")).select(*keys, "name", "category", "m.*")
        out = out.unionByName(extra.join(out.filter("name = 'Go'").select(*keys), keys, "left_anti"))
    out = out.withColumn("context", context_of())
    return out.withColumns({"level": level_of(F.col("context")), "version": version_of(F.col("context"), F.col("name"))}).drop("text")


def stacks(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per text: names of each level in order of mention, and how many."""
    names = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("offset", "name")))), lambda x: x["name"]).alias(level)
    return found.groupBy(*keys).agg(*map(names, SIGNS), F.count(F.lit(1)).alias("total"))


def by_category(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per text and category: names in order of mention and how many; mandatory, nice_to_have, forbidden: those of each level."""
    names = lambda when, alias: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("offset", "name")))), lambda x: x["name"]).alias(alias)
    return found.groupBy(*keys, "category").agg(names(F.lit(True), "names"), *[names(F.col("level") == level, level) for level in SIGNS], F.count(F.lit(1)).alias("total"))


def stack_sentence() -> Column:
    part = lambda c, most, label, rest=None: F.when(F.size(c) > 0, F.concat(
        F.lit(label), F.array_join(F.slice(c, 1, most) if most else F.col(c), ", "), F.when(F.size(c) > most, F.concat(F.lit(" (+"), (F.size(c) - most).cast("string"), F.lit(" más)"))).otherwise("") if rest else F.lit("")))
    text = F.concat_ws(". ", part("mandatory", 5, "Stack requerido: ", True), part("nice_to_have", 3, "Deseable: "), part("forbidden", None, "Prohibido: "))
    return F.when(text == "", "No se detectaron tecnologías.").otherwise(F.concat(text, F.lit(".")))


def compatibility(tenders: DataFrame, companies: DataFrame, bids: DataFrame, keys: list[str]) -> DataFrame:
    """Every bid (keys, company) of a company (company, stack) for a tender (stacks()): matched, missing, extra, conflicts, score, blockers.

    Two joins on keys, so the work follows the number of bids.
    """
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    pairs = bids.select(*keys, "company").join(tenders, keys).join(companies.select("company", "stack", low(F.col("stack")).alias("have")), "company")
    has = lambda x: F.array_contains("have", F.lower(x))
    out = pairs.select(
        *keys, "company", F.array_sort(F.filter("mandatory", has)).alias("matched"), F.array_sort(F.filter("mandatory", lambda x: ~has(x))).alias("missing"),
        F.filter("stack", lambda s: ~F.array_contains(low(F.col("mandatory")), F.lower(s))).alias("extra"), F.array_sort(F.filter("forbidden", has)).alias("conflicts"), F.size("mandatory").alias("required"))
    raw = F.when(F.col("required") == 0, 1.0).otherwise(F.size("matched") / F.col("required"))
    score = F.when(F.size("conflicts") > 0, F.greatest(F.lit(0.0), raw - F.size("conflicts") * 0.3)).otherwise(raw)
    return out.select(*keys, "company", "matched", "missing", "extra", "conflicts", F.bround(score, 2).alias("score"), (F.size("conflicts") > 0).alias("has_blockers"))


def report(found: DataFrame, keys: list[str]) -> DataFrame:
    sign = F.lit("")
    for level, mark in SIGNS.items():
        sign = F.when(F.col("level") == level, mark).otherwise(sign)
    line = F.concat(F.lit("- "), sign, F.lit(" "), "name", F.coalesce(F.concat(F.lit(" "), "version"), F.lit("")), F.lit(" ["), "category", F.lit("] - "), "level")
    rows = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("offset", line.alias("line"))))), lambda x: x["line"]).alias(level)
    per = found.groupBy(*keys).agg(*map(rows, SIGNS), F.count(F.lit(1)).alias("total"))
    lits = lambda *s: F.array(*map(F.lit, s))
    some = lambda c, none: F.when(F.size(c) > 0, F.col(c)).otherwise(lits(none))
    text = F.concat(
        lits("## Análisis de Stack Tecnológico", ""), F.array(F.format_string("**Total detectado**: %d tecnologías", F.col("total"))), lits("", "### Stack Obligatorio"), some("mandatory", "- Ninguno detectado"),
        lits("", "### Tecnologías Deseables"), some("nice_to_have", "- Ninguna"), F.when(F.size("forbidden") > 0, F.concat(lits("", "### ⚠️ Tecnologías Prohibidas"), F.col("forbidden"))).otherwise(F.array().cast("array<string>")))
    return per.select(*keys, F.array_join(text, "\n").alias("report"))
