r"""Secret scan: candidates by pattern, false positives removed by a random forest, all in native expressions.

Candidates are runs of key-like characters with a digit or an issuer's beginning, and values after ``=`` or ``:``. A random
forest decides on a candidate's length, the transitions between its kinds of characters, the share of it that
dictionary words cover, whether it is part of a path, and the words beside it. The forest is trained by Spark's own
learner on labelled findings and written out as one CASE expression, so a scan is a projection: no shuffle, no Python,
and any text is taken whole.

The findings come from a generator of forms (``labelled_findings``) or from the caller's own table of (before, value,
after, label). Null texts have no candidates; redaction leaves them null. Empty texts, repeated rows, texts of any length and empty tables
come out as they are; a column of the result's name is replaced, and others of any name stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names whose assigned values are secrets, and words beside harmless identifiers.
SECRET_NAMES = ("api_key", "apikey", "access_key", "auth", "credential", "passphrase", "passwd", "password", "private_key", "pwd", "secret", "token")
HARMLESS_NAMES = ("build", "card", "checksum", "commit", "digest", "hash", "isbn", "md5", "order", "phone", "revision", "sha1", "sha256", "tel", "uuid", "version")
#: Dictionary for coverage: short frequent words and endings that real words are made of.
DICTIONARY = (
    "about after again and are back because been before but can change check code come config could data date day default example file find first for from "
    "good have her here him his home how image index into just know like line list live long look main make many more most name new not now number one only "
    "other out over page part people place print public read report right said same see set she should some state such take test than that the their them then "
    "there these they thing think this time two type use user value very want was way well were what when where which while who will with word work world would "
    "year you your ing ion tion ment ness able heit keit ung schaft que eau aux ción ado"
).split()

_RUN = "A-Za-z0-9_+/-"
#: Beginnings of keys by their issuers' formats (fixed values): what follows one is a candidate without a digit too.
ISSUED = "AKIA|ASIA|AIza|gh[pousr]_|[prs]k_(?:live|test)_|xox[abprs]-"
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z_+/-]*+[0-9]|{ISSUED})[{_RUN}]{{12,}}+={{0,2}}" + r"|(?<=[=:][\s\"']{0,3})[^\s\"'<>=:]{8,}+"
FEATURES = ("length", "transitions", "coverage", "digits", "in_path", "secret_beside", "harmless_beside", "upper_mix", "variety", "issued", "reference", "encoded")
#: What stands for a value: dotted or bracketed code, constants in capitals, and words that ask for one's own. What is encoded data or an id
#: in an address: its beginning, and what is before it.
REFERENCE = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|->|::)[A-Za-z_$][A-Za-z0-9_$]*)+$|[(){}\[\]]|^\$|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^(?:<|_)*(?i:your|my|insert|replace|example|sample|dummy|placeholder|changeme|xxx)"
ENCODED = r"^(?:[a-z]+/[a-z0-9.+-]+;)?base64,|^sha(?:1|256|384|512)-|&[a-z_]+$"
ENCODED_BEFORE = r"(?:base64,|sha(?:1|256|384|512)-|[?&][A-Za-z_]{1,12}=)$"
#: Characters of context on either side that the features see.
BEFORE, AFTER = 48, 24


def features(before: Column, value: Column, after: Column) -> list[Column]:
    """The forest's inputs, in the order of FEATURES, as doubles."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))
    lower = F.lower(value)
    covered = size - F.length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    near = F.lower(F.concat(before, F.lit(" "), after))
    assigned = F.lower(before).rlike(rf"(?:{'|'.join(SECRET_NAMES)})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$")
    return [
        size,
        (runs - 1) / size,
        covered / size,
        F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        (before.rlike(r"(?:[/\\.]|://\S*)$") | after.rlike(r"^[/\\]|^\.[A-Za-z0-9]{1,5}\b") | (F.length(F.regexp_replace(value, "[^/]", "")) >= 2)).cast("double"),
        F.when(assigned, 2.0).when(near.rlike("|".join(SECRET_NAMES)), 1.0).otherwise(0.0),
        near.rlike(rf"\b(?:{'|'.join(HARMLESS_NAMES)})\b").cast("double"),
        (value.rlike("[A-Z]").cast("double") + value.rlike("[a-z]").cast("double") + value.rlike("[0-9]").cast("double")),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(40.0)),
        value.rlike(rf"^(?:{ISSUED})[A-Za-z0-9_-]{{12,}}$").cast("double"),
        value.rlike(REFERENCE).cast("double"),
        (value.rlike(ENCODED) | before.rlike(ENCODED_BEFORE)).cast("double"),
    ]


def labelled_findings(spark: SparkSession, rows: int = 9_000, salt: str = "finding") -> DataFrame:
    """(before, value, after, label): forms of secrets (1) and of what only looks like one (0), made from digests of row numbers."""
    hexed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 512)
    base = spark.range(rows).select("id", hexed.alias("hex"), F.base64(F.unhex(hexed)).alias("b64"))
    base = base.select("id", "hex", F.regexp_replace("b64", "[+/=]", "x").alias("mix"), F.conv(F.substring("hex", 1, 6), 16, 10).cast("int").alias("r"), F.translate(F.upper(F.substring("hex", 20, 60)), "0189", "GKQX").alias("upper"))
    digits = "translate(substring(hex, 40, 60), 'abcdef', '123456')"
    word = "element_at(array('stone','river','handler','window','market','update','report','inging','thereon','station'), 1 + r % 10)"
    other = "element_at(array('the ','and then ','see ','of ','with ','in ','as ','for '), 1 + shiftright(r, 4) % 8)"
    name = "element_at(array('password=','token = \"','secret: ','api_key = ','pwd=','passwd: ','access_key=\"','auth_token: '), 1 + shiftright(r, 7) % 8)"
    harmless = "element_at(array('commit ','sha1 ','md5: ','checksum ','digest=','build ','uuid ','version '), 1 + shiftright(r, 7) % 8)"
    forms = [
        (other, "concat('AKIA', substring(upper, 1, 16))", "' '", 1),
        (name, "substring(hex, 1, 18)", "' and'", 1),
        (name, "substring(hex, 1, 40)", "'\" the'", 1),
        (name, "substring(mix, 1, 16 + r % 28)", "'\"'", 1),
        (other, "concat('ghp_', substring(mix, 1, 36))", "' '", 1),
        (other, "concat('sk_live_', translate(substring(mix, 1, 24), '0123456789', 'abcdefghij'))", "' '", 1),
        (other, "concat('AKIA', translate(substring(upper, 1, 16), '0123456789', 'ABCDEFGHIJ'))", "' '", 1),
        (other, "substring(mix, 1, 32 + r % 12)", "' of'", 1),
        (name, "concat(substring(mix, 1, 6), element_at(array('moon','Tiger','blue'), 1 + r % 3), substring(hex, 9, 3))", "' '", 1),
        (harmless, "substring(hex, 1, 40)", "' the'", 0),
        (harmless, "substring(hex, 1, 32)", "' '", 0),
        (other, f"concat('4', substring({digits}, 1, 15))", "' of'", 0),
        ("'call +1 555 '", f"substring({digits}, 1, 12 + r % 4)", "' '", 0),
        (other, f"concat({word}, '-', {word}, '-', r % 1000)", "' '", 0),
        ("'https://www.example.com/'", f"concat('en/', {word}, '/', r, '/', {word})", "'.html'", 0),
        ("'/usr/lib/'", f"concat({word}, '_', {word}, r % 100, '/', {word})", "'.py'", 0),
        (other, f"concat({word}, {word}, r % 10)", "', '", 0),
        (other, "concat('20', 10 + r % 15, '-', 10 + r % 3, '-', 10 + r % 19, 'T10-', 10 + r % 50)", "' '", 0),
        (name, "'changeme1234'", "' '", 0),
        (name, "concat('example-', element_at(array('password','value','token','key'), 1 + r % 4), '-1')", "' '", 0),
        ("'uuid '", "concat_ws('-', substring(hex, 1, 8), substring(hex, 9, 4), substring(hex, 13, 4), substring(hex, 17, 4), substring(hex, 21, 12))", "' '", 0),
        (other, f"substring({digits}, 1, 12 + r % 12)", "' '", 0),
        (f"concat({word}, ': ')", f"concat({word}, {word})", "' the'", 0),
        (f"concat({word}, '=')", f"concat({word}, '_', {word})", "' '", 0),
        ("'see https:'", f"concat('//www.', {word}, '.example.com/', r)", "' '", 0),
        ("'Note: '", f"concat({word}, 'ation,')", "' and'", 0),
        ("'https://api.example.com/v1?access_token='", "substring(hex, 1, 32 + r % 9)", "' '", 1),
        (name, "concat('eyJ', substring(mix, 1, 20), '.eyJ', substring(mix, 22, 40), '.', substring(mix, 30, 43))", "' '", 1),
        (name, f"concat('settings.', upper({word}), '_KEY_', r % 10)", "' '", 0),
        (name, f"concat('os.environ[', upper({word}), '_TOKEN', r % 10, ']')", "' '", 0),
        (name, f"concat('cfg.', {word}, '.', {word}, 'Key', r % 10)", "', '", 0),
        ("'integrity=\"'", "concat('sha256-', substring(mix, 1, 43))", "'\" '", 0),
        ("'src: url(data:'", "concat('font/woff2;base64,', mix, mix, substring(mix, 1, r % 80))", "' '", 0),
        ("'data:text/css;base64,'", "concat(mix, substring(mix, 1, r % 80))", "'= '", 0),
        ("concat('https://shop.example.com/item?ref=')", "substring(mix, 1, 10 + r % 26)", "' '", 0),
        ("concat('https://shop.example.com/item?a=1&page=')", "concat(substring(mix, 1, 9 + r % 6), '&lang')", "'=de '", 0),
        (other, f"concat(upper({word}), r % 10, '_MOUSE_Q', substring({digits}, 1, 5))", "' '", 0),
        (name, "concat(element_at(array('MY_','INSERT_','REPLACE_'), 1 + r % 3), 'KEY_HERE_', r % 10)", "' '", 0),
        (name, "concat('xxxxxxxx-', element_at(array('replace','insert','dummy'), 1 + r % 3), '-', r % 100)", "' '", 0),
    ]

    def pick(at: int) -> Column:
        branches = " ".join(f"when {i} then {f[at]}" for i, f in enumerate(forms))
        return F.expr(f"case id % {len(forms)} {branches} end")

    return base.select(pick(0).alias("before"), pick(1).alias("value"), pick(2).alias("after"), pick(3).cast("int").alias("label"))


def train_forest(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 5) -> str:
    """A random forest over labelled findings, as SQL over array ``f`` of FEATURES giving the share of votes for a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    named = findings.select(*[c.cast("double").alias(n) for n, c in zip(FEATURES, features(F.col("before"), F.col("value"), F.col("after")))], F.col("label").cast("double").alias("label"))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(named).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    return "(" + " + ".join(_case(t._call_java("rootNode")) for t in model.trees) + f") / {float(trees)}D"


def _case(node) -> str:
    if "Leaf" in node.getClass().getSimpleName():
        counts = list(node.impurityStats().stats())
        return f"{counts[1] / max(1e-9, sum(counts)):.6f}D"
    split = node.split()
    return f"(case when f[{split.featureIndex()}] <= {split.threshold()!r}D then {_case(node.leftChild())} else {_case(node.rightChild())} end)"


def scan(docs: DataFrame, forest: str, text: str = "text", threshold: float = 0.5, out: str = "scan") -> DataFrame:
    """``docs`` with a struct ``scan``: candidates (number), findings array<struct<start, length, value, score>> of accepted
    ones (start counts code points from 1), redacted (the text with each finding replaced by ``[SECRET]``)."""
    # what came in is one struct, so that no name in it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    found = rows.withColumn("found", F.regexp_extract_all("x", F.lit(CANDIDATE), F.lit(0)))
    # few texts have a candidate, so few are cut
    kept = found.withColumn("gaps", F.when(F.size("found") > 0, F.split("x", CANDIDATE, -1)).otherwise(F.array("x")))

    def item(value: Column, i: Column) -> Column:
        # a name before the value may be a candidate itself, so the text is read on over the neighbours
        before = F.right(F.concat(F.right(F.coalesce(F.get("found", i - 1), F.lit("")), F.lit(BEFORE)), F.right(F.get("gaps", i), F.lit(BEFORE))), F.lit(BEFORE))
        after = F.left(F.concat(F.left(F.get("gaps", i + 1), F.lit(AFTER)), F.left(F.coalesce(F.get("found", i + 1), F.lit("")), F.lit(AFTER))), F.lit(AFTER))
        return F.struct(value.alias("value"), F.array(*[c.cast("double") for c in features(before, value, after)]).alias("f"))

    kept = kept.withColumn("items", F.transform("found", item))
    scored = kept.withColumn("scored", F.expr(f"transform(items, x -> struct(x.value as value, {forest.replace('f[', 'x.f[')} as score))"))
    taken = scored.withColumn("parts", F.expr(f"transform(gaps, (g, i) -> struct(g as gap, get(scored, i).value as value, get(scored, i).score as score, coalesce(get(scored, i).score >= {threshold}D, false) as secret))"))
    # only accepted findings are placed: each one's start is the length of what lies before it, summed once along the text
    placed = F.expr(
        "aggregate(parts, struct(1 as at, cast(array() as array<struct<start:int,length:int,value:string,score:double>>) as done), "
        "(a, p) -> struct(a.at + length(p.gap) + coalesce(length(p.value), 0) as at, "
        "if(p.secret, array_append(a.done, struct(a.at + length(p.gap) as start, length(p.value) as length, p.value as value, p.score as score)), a.done) as done)).done"
    )
    redacted = F.when(F.col(f"row.`{text}`").isNotNull(), F.array_join(F.transform("parts", lambda p: F.concat(p["gap"], F.when(p["secret"], "[SECRET]").otherwise(F.coalesce(p["value"], F.lit(""))))), ""))
    whole = F.struct(F.size("found").alias("candidates"), placed.alias("findings"), redacted.alias("redacted"))
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return taken.select(*keep, whole.alias(out))
