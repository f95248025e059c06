"""Secret scans (operator 2): candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is an unbroken run of at least 16 characters of keys and codes with a digit among them, a run that starts as
known keys do, a web token with its dots, or a private key, from its BEGIN line to its END line or last base64 line; and, of any length and alphabet, what
follows a name of keys, secrets, passwords or tokens and a sign of assignment (in quotes, all up to the closing one), an
option of such a name, an authorization scheme, and the password in a URL. Its features: length, shares of character kinds, transitions between them, letter pairs that words have,
coverage by a small dictionary, the path (the document's source) and the words before and after. The forest is trained
by Spark's own library on labelled findings (candidate, before, after, path, is_secret): a table of yours, or the seeded
one of ``labelled_findings``, at most ``ROWS`` rows. Its trees are then written out as one expression over a candidate's
features, so scanning and redacting are one map over each document: no shuffle, no Python, and memory of one document.

Null and empty texts have no findings; a null path counts as an empty one; an empty table has no rows. Columns other than
the text and the path are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stage

_NEWLINE = r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+"
_BASE64 = r"""(?:[A-Za-z0-9+/]{32,}+={0,2}|[A-Za-z0-9+/]++={0,2}(?=[ \t]*+(?:[\r\n\\"'<]|$)))"""
_KEY = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----(?:[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:(?:{_NEWLINE}[A-Za-z\-]++: [^\r\n]*+)*+(?:{_NEWLINE}|[ \t])++{_BASE64}(?:{_NEWLINE}{_BASE64})*+)?+)"
)
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])(?:eyJ[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]{4,}){1,4}|(?:gh[opsur]_|github_pat_|glpat-|AKIA|ASIA|sk_live_|sk-|xox[abprs]-|AIza|npm_)[A-Za-z0-9+/_\-]{12,}"
    r"|(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2})"
    rf"|{_KEY}"
)
_NAMES = r"(?:key|secret|passw(?:or)?d|passphrase|passcode|\bpass|pwd|token|credentials?)"
_QUOTES = r"""["'`\\]"""
#: What stands before a value: a name and a sign of assignment, "is" after a name, an option, or an authorization scheme.
_LED = (
    rf"(?<=[\s:=>]|{_QUOTES})(?:(?<=[:=>][\s\"'`\\]{{0,18}})(?<=(?i:{_NAMES})[\w.\-]{{0,24}}[\"'`\\\]]{{0,3}}\s{{0,16}}(?:[:=]|:=|==|=>)\s{{0,16}}{_QUOTES}{{0,2}})"
    rf"|(?<=(?i:--[\w\-]{{0,20}}{_NAMES}[\w\-]{{0,12}}|\b{_NAMES}\s{{1,2}}(?:is|was):?|authorization[\"'\\]{{0,2}}\s{{0,4}}[:=]\s{{0,4}}[\"'\\]{{0,2}}(?:bearer|basic|token))\s{{1,4}}{_QUOTES}{{0,2}}))"
)
_VALUE = r"""(?:(?<=")(?:[^"\r\n\\]++|\\[^"\r\n])++|(?<=')(?:[^'\r\n\\]++|\\[^'\r\n])++|(?<=`)[^`\r\n]++|(?<!["'`])(?!["'`\\=>])[^\s"'`<>]*[^\s"'`<>.,;:)\]}])"""
_USERINFO = r"""(?<=://[^\s/:@"'<>]{0,64}:)[^\s/"'<>]+(?=@[\w\[])"""
#: All candidates (lookbehind of bounded length, as the JVM has it), and what every text with one holds.
FIND = f"{_KEY}|{_USERINFO}|{_LED}{_VALUE}|{CANDIDATE}"
HAS_LED = rf"(?i:{_NAMES}[\w.\-]{{0,24}}[\"'`\\\]]{{0,3}}\s{{0,16}}[:=]|--[\w\-]{{0,20}}{_NAMES}|{_NAMES}\s{{1,2}}(?:is|was)\b|authorization)"
HAS_USERINFO = r"://[^\s/@]*:[^\s/]+@"
# What a text must hold, in lower case, for a value that is led by a name, and for a candidate without digits.
_LEADS = ("key", "secret", "pass", "pwd", "token", "credential", "authorization")
_FORMS = ("eyJ", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "AKIA", "ASIA", "sk_live_", "sk-", "xox", "AIza", "npm_", "-----BEGIN")
#: Characters of context on either side, and how many neighbouring candidates, of at least 3 characters with the gaps
#: before them, those can reach over.
CONTEXT, REACH = 48, 16
#: Bound on the labelled findings that the forest is trained on.
ROWS = 6_000
TREES, DEPTH, SEED = 15, 6, 20240611
MASK = "[SECRET]"

# Words that show what a finding is. The dictionary is of common words in identifiers and paths.
_KEYS = r"(?i)(token|secret|passw|pwd|api.?key|auth|credential|private|access.?key|bearer|client.?key|signing)"
_CODES = r"(?i)(sha\W?[0-9]*|commit|hash|checksum|digest|md5|uuid|guid|etag|revision|integrity|build|version|phone|order|invoice|card|isbn|account|tel|id)"
_FAKE = r"(?i)(example|sample|placeholder|changeme|dummy|your|xxxx|0000|1234567|abcdef|redacted)"
_PASS = r"(?i)(passw|pwd|passphrase|passcode|\bpass)[\w\-]{0,12}(?:\W{0,8}|\W{1,3}(?:is|was)\W{1,4})$"
_FILLER = r"(?i)^(none|null|nil|true|false|undefined|string|str|text|passw(or)?d|pass|pwd|secret|token|key|required|optional|hidden|empty|todo|tbd|n/?a|value|type|int|bool|bytes|char|any|object|bearer|basic|[*x.#_\-]+)$"
_REFERENCE = r"^[$%{<\[&@]|[(){}]|^(?:os|process|env|config|settings|self|this|request|args|secrets|vars|data)\.|::|->"
_WORDS = (
    "about access account action admin after again application array assets async backup base batch before block body bootstrap buffer build button cache "
    "class client cloud column common component config connect container content context control convert count create current customer data database date "
    "default delete demo deploy detail device directory docker document domain download dummy element email enable engine error event example export field file "
    "filter folder font form format frame from function github global group handler header height hidden home host html http icon image import index info input "
    "install item java key label language layout length library license line link linux list load local lock login machine main manager mapping master max "
    "memory menu message method min mobile model module month name native network node notes number object online option order output package page panel "
    "param parent parse password path pattern phone picture placeholder platform plugin port post print private process product profile project property proxy "
    "public query random read record release remote report request resource response result return role root route sample schema script search secret select "
    "server service session setting shared simple size source stack start state static status storage stream string style submit system table target task "
    "template test text theme thread time title token tool type update upload user util value version video view web width window word work your"
)


def _dictionary() -> str:
    return "(" + "|".join(sorted(_WORDS.split(), key=len, reverse=True)) + ")"


def features(c: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate, all doubles."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(c)

    def share(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    def yes(col: Column, pattern: str) -> Column:
        return F.when(col.rlike(pattern), 1.0).otherwise(0.0)

    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "hex": share("[0-9a-f]", low),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digit_turns": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "case_turns": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "doubles": share(r"(.)(?=\1)"),
        "syllables": share("[aeiou](?=[bcdfghjklmnpqrstvwxyz])|[bcdfghjklmnpqrstvwxyz](?=[aeiou])", low),
        "coverage": 1.0 - F.length(F.regexp_replace(low, _dictionary(), "")) / n,
        "fake": yes(c, _FAKE),
        "known_form": yes(c, r"^(ghp_|gho_|github_pat_|glpat-|AKIA|ASIA|sk_live_|sk-|xox[abprs]-|AIza|eyJ|npm_|-----BEGIN)"),
        "path_test": yes(path, "(?i)(test|spec|example|sample|fixture|mock|doc)"),
        "path_made": yes(path, r"(?i)(lock|\.sum|\.svg|\.min\.|\.map|vendor|node_modules)"),
        "key_near": yes(before, _KEYS + r"[\w\-]{0,12}\W{0,8}$"),
        "key_about": yes(F.concat(before, F.lit(" "), after), _KEYS),
        "code_near": yes(before, r"(?:^|\W)" + _CODES + r"[\w\-]{0,6}\W{0,8}$"),
        "assigned": yes(before, r"""[=:]\s*["']?$"""),
        "quoted": yes(after, r"""^["']"""),
        "pass_near": yes(before, _PASS),
        "userinfo": F.when(before.rlike(r"://[^\s/:@]*:$") & after.rlike("^@"), 1.0).otherwise(0.0),
        "web_token": yes(c, r"^eyJ[\w\-]+\.[\w\-]+"),
        "symbols": share(r"[^\w\s]"),
        "spaces": share(r"\s"),
        "key_block": yes(c, "^-----BEGIN"),
        "filler": yes(c, _FILLER),
        "reference": yes(c, _REFERENCE),
        "in_path": yes(F.concat(F.right(before, F.lit(1)), c), r"^[/.\\]|[/].*[/]"),
    }


def labelled_findings(spark: SparkSession, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """Seeded findings with labels, made in SQL: columns candidate, before, after, path, is_secret.

    Secrets: hex, base64, letter-digit and letter keys that are assigned to something named token, secret, password or
    key, keys of known forms anywhere, web tokens, short passwords and those with marks or of words, and passwords in
    URLs. Others: numbers, hashes named as such, ids, placeholders, dates, names and paths, and what else follows such
    names: types, references to variables, single words, numbers, and values of keys that open nothing.
    """
    # the hash, what is spelled from it and the parts are columns, so that plans don't repeat them in each kind
    base = spark.range(0, rows, 1, 1).withColumn("h", F.sha2(F.concat_ws(".", F.lit(str(seed)), "id"), 256))
    base = base.withColumn("hx", F.concat("h", F.sha2(F.concat("h", F.lit("b")), 256)))
    base = base.withColumns({"letters": F.regexp_replace(F.base64(F.unhex("hx")), "[+/=]", "x"), "digits": F.translate("hx", "abcdef", "012345")})
    h, hx, letters, digits = map(F.col, ("h", "hx", "letters", "digits"))

    def one(values: list[str], at: int) -> Column:
        number = F.conv(F.substring(h, at, 4), 16, 10).cast("int")
        return F.element_at(F.array(*map(F.lit, values)), number % len(values) + 1)

    word = one("user data config page report value module sample order index file cache image table build client".split(), 5)
    word2 = one("list store test name path group event view total start query state panel model field input".split(), 9)
    named = F.concat(one(["", "the ", "my_", "prod_", "x-", "export ", "aws_", "the new ", "our_"], 13), one("token secret password api_key apikey access_key auth_token client_secret private_key TOKEN SECRET API_KEY PASSWORD".split(), 17), one([' = "', "=", ": ", ' = \'', ":", '": "', " "], 21))
    plain = one(["and the other ", "see ", "on the ", "la le que ", "der die ", "(", "", "of ", "file ", "at "], 25)
    code = F.concat(one(["commit ", "sha256:", "sha1 = \"", "md5: ", "checksum=", "hash: ", "etag \"", "revision ", "integrity: \"", "digest ", "build "], 29))
    ids = one(["id: ", "uuid=", "guid ", "request id ", "phone ", "card ", "order ", "invoice ", "account ", "tel: "], 33)
    path = one(["src/app.py", "config/prod.env", "docs/readme.md", "tests/test_api.py", "package-lock.json", "src/main.rs", "lib/util.js", "web", "", "notes.txt", "go.sum"], 37)
    end = one(['"', "'", " ", "\n", ",", " and the", '" enough', ". "], 41)
    size = one(["20", "24", "32", "32", "40", "40", "40", "48", "64", "64"], 45).cast("int")
    date = F.concat(F.lit("2024-0"), F.substring(digits, 1, 1), F.lit("-1"), F.substring(digits, 2, 1), F.lit("T0"), F.substring(digits, 3, 7))
    uuid = F.concat_ws("-", *[F.substring(hx, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    form = F.concat(one(["ghp_", "glpat-", "AKIA", "sk_live_", "xoxb-", "AIza", "npm_", "eyJ"], 49), F.substring(letters, 1, 36))
    only = F.translate(letters, "0123456789", "ghkmpqrstv")
    short = one(["6", "7", "8", "8", "9", "10", "12", "14"], 45).cast("int")
    mark = one(["!", "@", "#", "$", "%", ".", ":", "!!", "&", "*"], 2)
    opening = one([' = "', "=", ": ", " = '", ":", '": "', " is ", "="], 21)
    passed = F.concat(one(["", "the ", "my_", "db_", "export ", "--", "admin ", "and "], 13), one("password Password PASSWORD passwd pwd db_password passphrase user_pass password".split(), 17), opening)
    other = F.concat(one(["", "sort_", "primary ", "the ", "max_", "cache ", "foreign_", "map "], 13), one("key keys key_name keyboard tokens tokenizer keyword monkey token_type key_id".split(), 17), one([' = "', "=", ": ", '": "', " is "], 21))
    common = one("the her him they that which about never nothing always hope love house water people good time way kept there".split(), 33)
    user = F.concat(one(["postgres", "https", "mysql", "redis", "amqp", "mongodb+srv", "ftp", "http"], 13), F.lit("://"), one(["admin", "user", "root", "", "app", "svc1"], 17), F.lit(":"))
    pem = F.concat(F.lit("-----BEGIN "), one(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "], 29), F.lit("PRIVATE KEY-----"))
    host = one(["@db.internal:5432/app", "@localhost/x", "@10.0.0.5", "@cache-1:6379", "@example.org"], 25)
    parts = {"word": word, "word2": word2, "named": named, "plain": plain, "code": code, "ids": ids, "path": path, "end": end, "size": size, "uuid": uuid, "short": short, "mark": mark, "passed": passed, "other": other, "pem": pem}
    base = base.withColumns(parts)
    word, word2, named, plain, code, ids, path, end, size, uuid, short, mark, passed, other, pem = map(F.col, parts)
    kinds: list[tuple[Column, ...]] = [
        (F.concat(F.initcap(word), F.substring(digits, F.lit(1), F.pmod(short, F.lit(4)) + 1)), passed, True),
        (F.concat(F.substring(letters, F.lit(3), short), F.substring(digits, 1, 1)), passed, True),
        (F.concat(F.initcap(F.translate(word2, "aeos", "@305")), mark, F.substring(digits, 1, 3), mark), passed, True),
        (F.concat(F.substring(letters, 2, 4), mark, F.substring(letters, F.lit(9), short), mark), F.concat(named), True),
        (F.concat(word, word2), passed, True),
        (F.concat_ws(" ", word, word2, one("horse river stone battery copper window".split(), 29), word2), F.concat(one(["passphrase", "password", "PASSWORD", "db_passwd"], 17), one([' = "', ": '", '": "'], 21)), True, F.lit('"')),
        (F.substring(only, F.lit(1), size), named, True),
        (F.concat(F.initcap(word), mark, F.substring(digits, 1, 4)), user, True, host),
        (F.substring(letters, F.lit(1), short), user, True, host),
        (F.concat(F.lit("eyJ"), F.substring(letters, 1, 17), F.lit(".eyJ"), F.substring(letters, 5, 30), F.lit("."), F.substring(letters, 1, 43)), one(["", "Authorization: Bearer ", "token: ", "jwt=", "see ", 'cookie "'], 53), True),
        (one("None null nil true false undefined string str text password secret token required optional hidden **** xxxx todo value bool bytes any Bearer".split(), 29), F.when(F.col("id") % 2 == 0, passed).otherwise(named), False),
        (F.concat(one(["${", "os.environ.", "process.env.", "{{", "<", "settings.", "config.get(", "$", "self.", "getpass("], 29), F.upper(word), F.lit("_"), F.upper(word2)), F.when(F.col("id") % 2 == 0, passed).otherwise(named), False),
        (F.when(F.col("id") % 3 == 0, F.substring(digits, F.lit(1), F.pmod(short, F.lit(4)) + 1)).when(F.col("id") % 3 == 1, word).otherwise(F.concat(word, F.lit("_"), word2)), other, False),
        (F.concat(pem, F.lit("\n"), F.substring(letters, 1, 64), F.lit("\n"), F.substring(letters, 9, 50), F.when(F.col("id") % 2 == 0, F.concat(F.lit("=\n"), F.regexp_replace(pem, "BEGIN", "END"))).otherwise("")), one(["", "\n", 'key = "', "private_key: ", "see "], 53), True),
        (F.concat(pem, F.when(F.col("id") % 2 == 0, F.concat(F.lit("\n...\n"), F.regexp_replace(pem, "BEGIN", "END"))).otherwise("")), plain, False),
        (F.concat(F.upper(word), one(["_SECRET_KEY_", "_API_TOKEN_", "_PASSWORD_", "_ACCESS_KEY_ID_"], 17), F.substring(digits, F.lit(1), F.pmod(short, F.lit(4)) + 1)), one(["", "\n", "export ", "env.", "the "], 53), False, one([' = "', "=", ": ", " -> "], 21)),
        (common, F.concat(one(["the ", "a ", "his ", "her ", ""], 13), one("secret token key password Secret".split(), 17), one([": ", " is ", ": ", " was "], 21)), False, F.lit(" ")),
        (F.substring(hx, F.lit(1), size), named, True),
        (F.upper(F.substring(hx, F.lit(1), size)), F.upper(named), True),
        (F.substring(letters, F.lit(1), size), named, True),
        (F.substring(F.base64(F.unhex(hx)), F.lit(1), size), named, True),
        (form, one(["", "use ", "and ", "key: "], 53), True),
        (F.substring(hx, F.lit(1), size), code, False),
        (F.substring(digits, F.lit(1), F.lit(16)), F.concat(plain, F.lit("")), False),
        (F.substring(digits, F.lit(1), F.lit(16)), ids, False),
        (uuid, ids, False),
        (F.concat(word, F.lit("_"), word2, F.lit("_"), F.substring(digits, 1, 3), F.lit("_"), word), plain, False),
        (F.concat(word, F.lit("/"), word2, F.lit("/"), word, F.substring(digits, 1, 1), F.lit("/"), word2), plain, False),
        (F.concat(one(["your_", "example-", "sample_", "dummy_"], 57), word, F.lit("_key_here_"), F.substring(digits, 1, 2)), named, False),
        (F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.substring(digits, 1, 4)), named, False),
        (F.concat(date, F.lit("-00")), plain, False),
        (F.concat(F.repeat(word2, 3), F.substring(digits, 1, 1)), plain, False),
    ]
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(kinds)))
    chosen = F.array(*[F.struct(c.alias("candidate"), b.alias("before"), F.lit(y).cast("int").alias("is_secret"), (after[0] if after else end).alias("after")) for c, b, y, *after in kinds])
    made = base.select(F.element_at(chosen, (pick + 1).cast("int")).alias("f"), "path")
    # staged, else a filter on these columns would repeat all that makes them
    return stage(made.select("f.candidate", "f.before", "f.after", "path", "f.is_secret"), "findings")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[str]:
    """A forest as SQL: one CASE over the features (fields of ``f``) for each tree, 1.0 for a secret."""
    made = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit("")))
    names = list(made)
    rows = findings.where("candidate is not null and is_secret is not null").limit(ROWS)
    rows = stage(rows.coalesce(1).select(*[x.alias(k) for k, x in made.items()], F.col("is_secret").cast("double").alias("label")), "features").coalesce(1)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label").cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3, featureSubsetStrategy="onethird").fit(rows)
    rows.unpersist()
    return [_case(iter(t.toDebugString.splitlines()[1:]), names) for t in model.trees]


def _case(lines, names: list[str]) -> str:
    """One tree of the library's printed form ("If (feature i <= x)", "Else", "Predict: y") as an expression."""
    line = next(lines).strip()
    if line.startswith("Predict"):
        return f"{float(line.split(':')[1])}D"
    at, bound = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
    yes = _case(lines, names)
    next(lines)  # Else
    return f"CASE WHEN f.{names[int(at)]} <= {float(bound)!r}D THEN {yes} ELSE {_case(lines, names)} END"


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def scanned(docs: DataFrame, forest: list[str], text_col: str = "text", path_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row as ``rec`` (a struct of the columns in ``keep``, by default all), its text, gaps and findings.

    findings: array of (candidate, score, is_secret) in the order of the text; gaps: what stands between them.
    """
    packed = docs.select(F.struct(*(keep or ["*"])).alias("rec"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    # plain searches decide which patterns can match at all; most texts need none
    led = F.exists(F.array(F.lower("text")), lambda t: _holds(t, _LEADS)) & F.col("text").rlike(HAS_LED) | F.col("text").contains("://") & F.col("text").rlike(HAS_USERINFO)
    run = (F.col("text").rlike("[0-9]") | _holds(F.col("text"), _FORMS)) & F.col("text").rlike(CANDIDATE)
    kind = F.when(led, F.lit(2)).when(run, F.lit(1)).otherwise(F.lit(0))
    none = F.array().cast("array<string>")

    def by_kind(f) -> Column:
        return F.when(F.col("kind") == 2, f(FIND)).when(F.col("kind") == 1, f(f"{_KEY}|{CANDIDATE}")).otherwise(none)

    rows = packed.withColumn("kind", kind)
    rows = rows.withColumns({"found": by_kind(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))), "gaps": by_kind(lambda p: F.split("text", p, -1))})

    # context is the text on either side, whether candidates or gaps
    rows = rows.withColumn("left", F.transform("found", lambda c, i: F.right(F.concat(F.get("gaps", i), c), F.lit(CONTEXT))))
    rows = rows.withColumn("right", F.transform("found", lambda c, i: F.left(F.concat(c, F.get("gaps", i + 1)), F.lit(CONTEXT))))

    def around(c: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice("left", F.greatest(i - (REACH - 1), F.lit(1)), F.least(i, F.lit(REACH))), ""), F.get("gaps", i))
        after = F.concat(F.get("gaps", i + 1), F.array_join(F.slice("right", i + 2, F.lit(REACH)), ""))
        return F.struct(c.alias("candidate"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    def seen(x: Column) -> Column:
        return F.struct(x["candidate"].alias("candidate"), *[y.alias(k) for k, y in features(x["candidate"], x["before"], x["after"], F.col("path")).items()])

    votes = " + ".join(f"({t})" for t in forest)
    share = f"({votes}) / {len(forest)}D"
    rows = rows.withColumn("seen", F.transform(F.transform("found", around), seen))
    rows = rows.withColumn("scored", F.expr(f"transform(seen, f -> named_struct('candidate', f.candidate, 'score', {share}))"))
    final = F.transform("scored", lambda s: F.struct(s["candidate"].alias("candidate"), s["score"].alias("score"), (s["score"] > 0.5).alias("is_secret")))
    return rows.select("rec", "text", "gaps", final.alias("findings"))


def redacted(docs: DataFrame, forest: list[str], text_col: str = "text", path_col: str = "source", mask: str = MASK) -> DataFrame:
    """The rows of ``docs`` with their columns, every secret in the text replaced; other texts as they are."""
    rows = scanned(docs, forest, text_col, path_col)
    parts = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.when(F.get("findings", i)["is_secret"], F.lit(mask)).otherwise(F.get("findings", i)["candidate"]), F.lit(""))))
    text = F.when(F.exists("findings", lambda f: f["is_secret"]), F.array_join(parts, "")).otherwise(F.col("text"))
    columns = [text.alias(c) if c == text_col else F.col("rec").getField(c).alias(c) for c in docs.columns]
    return rows.select(*columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents: doc_id, nth (from 1), finding_sha256, n_chars, score, is_secret."""
    rows = scanned(load(spark, sf_dir, "documents"), train(labelled_findings(spark)), keep=("doc_id",))
    # the inner form would have its non-empty test, with all that makes the findings, run once more below it
    out = rows.select("rec.doc_id", F.posexplode_outer("findings").alias("at", "f")).where("f is not null")
    return out.select("doc_id", (F.col("at") + 1).alias("nth"), F.sha2("f.candidate", 256).alias("finding_sha256"), F.length("f.candidate").cast("long").alias("n_chars"), "f.score", "f.is_secret")
