"""What notes state: relations, facts, registry values, bullets, names, personas, state fields, conditions and evidence.

Every extractor is one projection: the patterns' matches become one array per row, which is exploded once, so a text is
read once whatever the number of patterns.  Patterns follow Unicode word characters (``(?U)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import lines, strip, tokens

KO = "[가-힯]+"
MIX = "[가-힯\\w]+"

#: English relation patterns; the case of letters doesn't count.
RELATIONS = [
    (r"\b(\w+)\s+works?\s+(?:at|for)\s+([A-Z]\w+)", "works_at"),
    (r"\b(\w+)\s+worked\s+(?:at|for)\s+([A-Z]\w+)", "works_at"),
    (r"\b(\w+)\s+lives?\s+in\s+([A-Z]\w+)", "lives_in"),
    (r"\b(\w+)\s+moved\s+to\s+([A-Z]\w+)", "lives_in"),
    (r"\b(\w+)\s+(?:likes?|loves?|enjoys?)\s+(\w+(?:\s+\w+)?)", "likes"),
    (r"\b(\w+)\s+is\s+(?:a|an)\s+(\w+(?:\s+\w+)?)", "is_a"),
    (r"\b(\w+)\s+(?:knows?|met)\s+([A-Z]\w+)", "knows"),
    (r"\b(\w+)\s+(?:studied|studies)\s+(?:at|in)\s+([A-Z]\w+)", "studied_at"),
    (r"\b(\w+)\s+(?:graduated|grad)\s+from\s+([A-Z]\w+)", "graduated_from"),
    (r"\b(\w+)\s+(?:married|dating)\s+([A-Z]\w+)", "partner_of"),
    (r"\b(\w+)'s\s+(?:hobby|hobbies)\s+(?:is|are|include)\s+(\w+(?:\s+\w+)?)", "hobby_is"),
    (r"\b(\w+)\s+(?:born|grew up)\s+in\s+([A-Z]\w+)", "born_in"),
]
#: Korean relation patterns.
KOREAN_RELATIONS = [
    (rf"({KO})[은는이가]?\s+({KO})\s*에서\s*(?:일하|일한|일해|일했|일함)\w*", "works_at"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에서\s*근무\w{{0,3}}", "works_at"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에\s*(?:다니|다닌|다녔|다녀|다님)\w*", "works_at"),
    (rf"({KO})[은는이가]\s+({KO})\s*(?:의\s*)?(?:CEO|대표(?!\s*적)|이사(?!\s*[하한했함])|팀장|개발자|디자이너|기획자|창업자|공동창업자|임원|디렉터|교수|연구원|매니저|파트너)", "works_at"),
    (rf"({KO})[의]\s+({KO})\s+(?:CEO|대표|이사|팀장)", "works_at"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에\s*(?:살|산다|살아|살고|삽니다|살았|사는)\w*", "lives_in"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에\s*거주\w{{0,3}}", "lives_in"),
    (rf"({KO})[은는이가]?\s+({KO}?)\s*(?:으로|로)\s*이사\w{{0,3}}", "lives_in"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*(?:좋아하|좋아한|좋아해|좋아했|좋아함|좋아함)\w*", "likes"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*(?:사랑하|사랑한|사랑해|사랑했|사랑함)\w*", "likes"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*(?:즐기|즐긴|즐겼|즐겨|즐김)\w*", "likes"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*선호\w{{0,3}}", "likes"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*(?:안다|아는\s|알고\s|알았|알게)", "knows"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*(?:만나|만난|만났|만남)\w*", "knows"),
    (rf"({KO})[은는이가]?\s+({KO})\s*(?:와|과)\s*(?:친한|친구|동료)", "knows"),
    (rf"({KO})[은는이가]\s+({KO})(?:이다|다)(?:\.|$|\s)", "is_a"),
    (rf"({KO})[은는이가]\s+({KO})\s*입니다", "is_a"),
    (rf"({KO})[은는이가]\s+({KO})\s*이자\s", "is_a"),
    (rf"({KO})[은는이가]?\s+({KO})(?:과|와)\s*(?:결혼하|결혼한|결혼했|결혼함)\w*", "partner_of"),
    (rf"({KO})(?:과|와)\s+({KO})[은는이가]?\s*(?:결혼하|결혼한|결혼했|결혼함|부부)\w*", "partner_of"),
    (rf"({KO})[의]\s+(?:남편|아내|배우자|와이프)는\s+({KO})", "partner_of"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에서\s*(?:공부하|공부한|공부했|공부함)\w*", "studied_at"),
    (rf"({KO})[은는이가]?\s+({KO})[를을]?\s*(?:졸업하|졸업한|졸업했|졸업함)\w*", "graduated_from"),
    (rf"({KO})[은는이가]?\s+({KO})\s*출신", "graduated_from"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에서\s*(?:태어났|태어난|태어남|태어나)\w*", "born_in"),
    (rf"({KO})[은는이가]?\s+({KO})\s*출생", "born_in"),
    (rf"({KO})[의]\s+취미는\s+({KO})", "hobby_is"),
    (rf"({KO})[은는이가]?\s+({KO})[을를]?\s*취미로", "hobby_is"),
    (rf"({KO})[은는이가]?\s+({KO})\s*에\s*(?:위치하|위치한|위치했|위치함)\w*", "located_in"),
    (rf"({KO})[은는이가]?\s+({KO})[의]\s+(?:자회사|계열사|파트너사)", "part_of"),
    (rf"({KO})[은는이가]?\s+({KO})\s*소속", "part_of"),
    (rf"({KO})[은는이가]?\s+({KO})[를을]?\s*(?:창업하|창업한|창업했|창업함)\w*", "founded"),
    (rf"({KO})[은는이가]?\s+({KO})[를을]?\s*(?:설립하|설립한|설립했|설립함)\w*", "founded"),
    (rf"({KO})[은는이가]?\s+({KO})[에]\s*(?:투자하|투자한|투자했|투자함)\w*", "invested_in"),
    (rf"({KO})[의]\s+(?:아버지|어머니|아빠|엄마|부친|모친)는\s+({KO})", "child_of"),
    (rf"({KO})[의]\s+(?:아들|딸|자녀|아이|자식)는\s+({KO})", "parent_of"),
    (rf"({KO})[은는이가]?\s+({KO})(?:과|와)\s+(?:함께\s+)?(?:일하|일한|일해|일했|일함)\w*", "works_with"),
    (rf"({KO})[의]\s+(?:멘토|스승|지도교수)는\s+({KO})", "advised_by"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*좋아한다", "likes"),
    (rf"({KO})[은는]\s+({MIX})\s*에서\s*근무한다", "works_at"),
    (rf"({KO})[은는]\s+({MIX})\s*에\s*산다", "lives_in"),
    (rf"({KO})[은는]\s+({MIX})이다", "is_a"),
    (rf"({MIX})[와과]\s+({MIX})[은는]?\s*친구이다", "knows"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*공부한다", "studied_at"),
    (rf"({KO})[은는]\s+({MIX})[에에]\s*참여한다", "participates_in"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*담당한다", "manages"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*개발한다", "develops"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*운영한다", "operates"),
    (rf"({KO})[은는이가]?\s+({MIX})[을를]\s*설립했다", "founded"),
    (rf"({KO})[은는이가]?\s+({MIX})[에에]\s*합류했다", "joined"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*이끈다", "leads"),
    (rf"({KO})[은는]\s+({MIX})[을를]\s*대표한다", "represents"),
    (rf"({KO})[은는]\s+({MIX})\s*소속이다", "part_of"),
]
#: Causal patterns (cause, then effect) and how the edge is named.
CAUSES = [
    (r"([가-힯\w]+)\s*(?:때문에|덕분에|으로\s*인해|로\s*인해|탓에)\s+([가-힯\w]+)", "caused_by"),
    (r"([一-鿿\w]+)\s*(?:导致|引起|造成)\s*([一-鿿\w]+)", "caused_by"),
    (r"\b([A-Za-z][\w]*)\s+caused\s+([A-Za-z][\w]*)", "caused_by"),
    (r"\b([A-Za-z][\w]*)\s+led\s+to\s+([A-Za-z][\w]*)", "caused_by"),
    (r"\b([A-Za-z][\w]*)\s+resulted\s+in\s+([A-Za-z][\w]*)", "resulted_in"),
]
#: Words that are no end of a relation.
STOPS = [
    "the", "a", "an", "is", "are", "was", "were", "what", "who",
    "where", "when", "how", "why", "did", "does", "do", "will",
    "would", "could", "should", "have", "has", "had", "be", "been",
    "their", "they", "this", "that", "with", "from", "about",
]
#: Korean words that are no end of a relation.
KOREAN_STOPS = [
    "그", "이", "저", "그는", "그녀", "그들", "우리", "이것", "저것", "그것",
    "이분", "그분", "저분", "자신", "본인", "당신", "너", "나",
    "어디", "언제", "어떻게", "왜", "무엇", "뭐", "누구", "누가",
    "지금", "아까", "조금", "아주", "너무", "더", "더욱", "거의",
    "그래서", "하지만", "그러나", "또한", "그리고", "그런",
    "같은", "같이", "동일", "아니", "아니라",
    "합니다", "입니다", "있습니다", "했다", "한다", "하다",
    "되다", "됐다", "있다", "없다", "같다", "다르다",
    "아니다", "이다", "일", "해", "함", "됨",
    "은", "는", "이", "가", "을", "를", "의", "에", "에서",
]
#: Particles at the end of a name, of which the longest is dropped first.
NAME_PARTICLES = [
    "으로서", "으로부터", "이라도", "이서부터",
    "한테", "에게", "로서", "에서", "으로",
    "까지", "부터", "마저", "조차", "밖에",
    "처럼", "만큼", "보다", "마다", "대로",
    "은", "는", "이", "가", "을", "를", "의", "에",
    "로", "와", "과", "도", "만", "랑", "이랑",
    "이나", "나", "며", "고", "이며",
]
#: Sentences that state a fact about a named person.
FACTS = [
    r"([A-Z][a-z]+ [A-Z][a-z]+) (?:is|was|serves as|joined|became|founded|leads|runs|leads) (.+?)(?:\.|,|;|$)",
    r"([가-힯]{2,4})(?:은|는|이|가) (.+?)(?:이다|다|했다|임|됨|\.)",
]
#: Key facts of a line; the case of letters doesn't count.
KEY_FACTS = [
    r"(\w+)\s+(?:works?|worked)\s+(?:at|for)\s+([A-Z]\w+(?:\s+[A-Z]\w+)*)",
    r"(\w+)\s+(?:lives?|lived|moved)\s+(?:in|to)\s+([A-Z]\w+(?:\s+[A-Z]\w+)*)",
    r"(\w+)\s+(?:likes?|loved?|enjoys?|prefers?|hates?)\s+(\w+(?:\s+\w+){0,3})",
    r"(\w+)\s+(?:is|was)\s+(?:a|an)\s+(\w+(?:\s+\w+){0,2})",
]
#: Fields of an entity's state; the first pattern that fits counts.
STATES = {
    "Role": [r"(?:^|\b)(?:role|title|position)\s*(?::|is|=)\s*(.+)$", r"\b(?:is|became|serves as|was named|appointed as)\s+(?:the\s+)?(.+?)(?:\.|$)"],
    "Affiliation": [r"(?:^|\b)(?:affiliation|company|organization|org)\s*(?::|is|=)\s*(.+)$", r"\b(?:joined|left|moved to)\s+(.+?)(?:\.|$)"],
    "Status": [r"(?:^|\b)status\s*(?::|is|=)\s*(.+)$"],
    "Location": [r"(?:^|\b)location\s*(?::|is|=)\s*(.+)$", r"\b(?:based in|located in)\s+(.+?)(?:\.|$)"],
}
#: Professions, and phrases behind which a persona's likes and dislikes stand.
PROFESSIONS = [
    "software engineer", "content creator", "teacher", "doctor", "lawyer", "designer", "writer", "analyst", "manager", "consultant", "therapist", "photographer",
    "musician", "artist", "chef", "researcher", "developer", "professor", "architect", "journalist", "entrepreneur", "freelancer", "student", "retired", "nurse",
    "engineer", "scientist", "editor", "producer", "director", "accountant", "pharmacist", "podcaster",
]
PERSONA = {
    "name": r"Name:\s*(.+?)[\r\n]",
    "gender": r"Gender Identity:\s*(.+?)[\r\n]",
    "age": r"(?i)(?:aged?\s+|is a\s+)(\d{1,3})[\s\-]+year",
    "race": r"Racial Identity:\s*(.+?)[\r\n]",
}
LIKES = r"(?i)(?:loves?|enjoys?|passionate about|keen (?:expertise|interest) in|fond of|interested in|excited about|deeply involved in)\s+([^\.,;\n]+)"
DISLIKES = r"(?i)(?:dislikes?|hates?|avoids?|not a fan of|doesn't like|don't enjoy)\s+([^\.,;\n]+)"

_HANGUL, _HAN = "[가-힯]", "[\\u4e00-\\u9fff]"


def strip_particles(word: Column) -> Column:
    """Drop particles from the end of a Korean word, up to four, while two characters stay."""
    pattern = "(?:" + "|".join(sorted(NAME_PARTICLES, key=len, reverse=True)) + ")$"

    def once(w: Column) -> Column:
        less = F.regexp_replace(w, pattern, "")
        return F.when(F.length(less) >= 2, less).otherwise(w)

    return F.when(word.rlike(_HANGUL), F.aggregate(F.sequence(F.lit(1), F.lit(4)), word, lambda w, _: once(w))).otherwise(word)


def pairs_of(text: Column, pattern: str) -> Column:
    """The first two groups of each match, as an array of ``a, b``."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*groups, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _named(pairs: Column, relation: str, kind: str) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(relation).alias("relation"), F.lit(kind).alias("kind")))


def relations(docs: DataFrame) -> DataFrame:
    """``doc_id, subject, relation, object, graph_type``: distinct relations that a document states.

    English patterns take both ends in lower case, two characters at least; Korean and causal ones drop particles first
    and let one Hangul (or, if causal, Han) character stand.  Ends are no stop words and, but for English, not equal.  A
    cause follows its effect: ``effect caused_by cause``; ``resulted_in`` leads from the cause.
    """
    c = F.col("content")
    none = F.array().cast("array<struct<a: string, b: string, relation: string, kind: string>>")
    english = [_named(pairs_of(c, "(?iU)" + p), r, "en") for p, r in RELATIONS]
    korean = [F.when(c.rlike(_HANGUL), _named(pairs_of(c, "(?U)" + p), r, "ko")).otherwise(none) for p, r in KOREAN_RELATIONS]
    causal = [_named(pairs_of(c, "(?U)" + p), r, "causal") for p, r in CAUSES]
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*english, *korean, *causal))).alias("m")).select("doc_id", "m.*")
    clean = lambda x: F.when(F.col("kind") == "en", F.lower(x)).otherwise(F.lower(strip_particles(F.col(x))))
    rows = rows.select("doc_id", "relation", "kind", F.trim(clean("a")).alias("a"), F.trim(clean("b")).alias("b"))
    alone = lambda x: (F.length(x) >= 2) | ((F.length(x) == 1) & (F.col("kind") != "en") & (F.col(x).rlike(_HANGUL) | ((F.col("kind") == "causal") & F.col(x).rlike(_HAN))))
    stop = lambda x: F.col(x).isin(STOPS) | ((F.col("kind") != "en") & F.col(x).isin(KOREAN_STOPS))
    kept = rows.where(alone("a") & alone("b") & ~stop("a") & ~stop("b") & ((F.col("kind") == "en") | (F.col("a") != F.col("b"))))
    turned = (F.col("kind") == "causal") & (F.col("relation") == "caused_by")
    ends = kept.select("doc_id", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("subject"), "relation", F.when(turned, F.col("a")).otherwise(F.col("b")).alias("object"), F.when(F.col("kind") == "causal", "causal").otherwise("entity").alias("graph_type"))
    return ends.distinct()


def stated_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, entity, fact``: sentences that say something of more than five characters about a named person."""
    c = F.col("content")
    rows = docs.select("doc_id", F.explode(F.concat(*[pairs_of(c, p) for p in FACTS])).alias("m"))
    return rows.select("doc_id", F.trim("m.a").alias("entity"), F.trim("m.b").alias("fact")).where((F.length("fact") > 5) & (F.length("entity") > 1))


def bullet_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, fact``: bullets of more than ten characters without source tags, marks and dates."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    fact = F.col("line")
    for p, by in ((r"\[Source:.*?\]", ""), (r"\[CONFLICT\]", ""), (r"^- \*\*\d{4}-\d{2}-\d{2}\*\* \| ", "- "), (r"^- ⏳ ", "- ")):
        fact = F.regexp_replace(fact, p, by)
    return rows.where(F.col("line").startswith("- ") & (F.length("line") > 10)).select("doc_id", "line_no", strip(F.regexp_replace(strip(fact), "^- ", "")).alias("fact")).where("fact != ''")


def key_facts(docs: DataFrame, most: int = 15) -> DataFrame:
    """``doc_id, facts``: up to ``most`` distinct ``subject: object`` of a document in order of the patterns, joined by
    bars; the first 300 characters without any."""
    c = F.col("content")
    said = [F.transform(pairs_of(c, "(?iU)" + p), lambda m: F.concat_ws(": ", m["a"], m["b"])) for p in KEY_FACTS]
    found = F.slice(F.array_distinct(F.concat(*said)), 1, most)
    return docs.select("doc_id", F.when(F.size(found) > 0, F.array_join(found, " | ")).otherwise(F.trim(F.translate(F.substring("content", 1, 300), "\n", " "))).alias("facts"))


def named_words(docs: DataFrame, most: int = 6) -> DataFrame:
    """``doc_id, names``: the first ``most`` capitalised words of three letters or more that are no stop words, in lower
    case, then Korean words."""
    c = F.col("content")
    latin = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-zA-Z]{2,}\b"), F.lit(0)), lambda w: F.lower(w)), lambda w: ~w.isin(STOPS))
    return docs.select("doc_id", F.array_join(F.slice(F.array_distinct(F.concat(latin, F.regexp_extract_all(c, F.lit("[가-힯]{2,}"), F.lit(0)))), 1, most), ",").alias("names"))


def personas(docs: DataFrame) -> DataFrame:
    """``doc_id, field, value``: name, gender, age, race, profession, up to 15 likes and 10 dislikes of a description."""
    c = F.col("content")
    job = F.lower(F.regexp_extract(c, rf"(?i)\b({'|'.join(PROFESSIONS)})\b", 1))
    told = {k: F.trim(F.regexp_extract(c, p, 1)) for k, p in PERSONA.items()} | {"profession": job}
    one = [F.array(F.struct(F.lit(k).alias("field"), v.alias("value"))) for k, v in told.items()]
    many = [_field("like", LIKES, 15), _field("dislike", DISLIKES, 10)]
    rows = docs.select("doc_id", F.explode(F.concat(*one, *many)).alias("m"))
    return rows.select("doc_id", "m.field", "m.value").where("value != ''")


def _field(name: str, pattern: str, most: int) -> Column:
    found = F.slice(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), 1, most)
    return F.transform(found, lambda v: F.struct(F.lit(name).alias("field"), F.trim(v).alias("value")))


def state_fields(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, field, value``: role, affiliation, status and location that a line states, 200 characters at
    most; of a field the first pattern that fits counts."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line")).where("line != ''")
    fields = []
    for name, patterns in STATES.items():
        found = F.coalesce(*[F.when(F.col("line").rlike("(?i)" + p), F.regexp_extract("line", "(?i)" + p, 1)) for p in patterns])
        fields.append(F.struct(F.lit(name).alias("field"), F.substring(F.regexp_replace(found, r"^[ .;]+|[ .;]+$", ""), 1, 200).alias("value")))
    return rows.select("doc_id", "line_no", F.inline(F.array(*fields))).where("value is not null and value != ''")


def conditions(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, value``: what stands behind ``When:`` and ``When NOT:`` up to a bar or bracket."""
    of = lambda kind, p: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value")))
    rows = docs.select("doc_id", F.explode(F.concat(of("when", r"When:\s*([^|\]\n]+)"), of("when_not", r"When NOT:\s*([^|\]\n]+)"))).alias("m"))
    return rows.select("doc_id", "m.kind", "m.value")


def condition_bonus(content: Column, goal: str) -> Column:
    """Lift of a text whose conditions fit a goal: 0.03 for each share of a condition's words that the goal has, less 0.02
    for each of an exclusion's; 0.1 at most, three decimals."""
    from loam.functions.text import tokens_of

    words = F.array(*[F.lit(w) for w in dict.fromkeys(tokens_of(goal))]).cast("array<string>")

    def shares(pattern: str) -> Column:
        found = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        one = lambda v: F.try_divide(F.size(F.array_intersect(words, F.array_distinct(tokens(v)))), F.size(F.array_distinct(tokens(v))))
        return F.aggregate(found, F.lit(0.0), lambda s, v: s + F.coalesce(one(v), F.lit(0.0)))

    total = 0.03 * shares(r"When:\s*([^|\]\n]+)") - 0.02 * shares(r"When NOT:\s*([^|\]\n]+)")
    return F.floor(F.least(F.lit(0.1), total) * 1000 + F.lit(0.5)) / F.lit(1000.0)


def evidence_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, at, hypothesis, result, evidence`` of the evidence lines ``- **time** | [Hn] … supports: …``."""
    p = r"- \*\*(.+?)\*\* \| \[(H\d+)\] (.+?) (supports|contradicts|neutral): (.+)"
    parts = [F.regexp_extract_all("content", F.lit(p), F.lit(i)) for i in (1, 2, 4, 5)]
    names = ("at", "hypothesis", "result", "evidence")
    rows = docs.select("doc_id", F.explode(F.arrays_zip(*[x.alias(n) for x, n in zip(parts, names, strict=True)])).alias("z"))
    return rows.select("doc_id", *[F.trim(f"z.{n}").alias(n) for n in names])


def tag_of(content: Column) -> Column:
    """What stands behind the first ``tag:``, ``tags:`` or ``태그:``, 50 characters at most; empty without one."""
    return F.substring(F.trim(F.regexp_extract(content, r"(?i)(?:tags?|태그):[ \t]*([^\n\r]+)", 1)), 1, 50)


def section_of(content: Column, name: str) -> Column:
    """Text between ``## name`` and the next heading of its level (or, without one, the next rule); empty without it."""
    import re

    rest = F.regexp_extract(content, rf"(?s)## {re.escape(name)}(.*)$", 1)
    until = F.when(rest.contains("\n## "), F.substring_index(rest, "\n## ", 1)).when(rest.contains("\n---"), F.substring_index(rest, "\n---", 1)).otherwise(rest)
    return F.regexp_replace(until, r"^\s+|\s+$", "")


def signature(text: Column) -> Column:
    """The four longest distinct words of a text in alphabetical order, joined by hyphens; a hash without any word.

    Words of one length are taken in alphabetical order.
    """
    words = F.transform(F.array_distinct(tokens(text)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    longest = F.transform(F.slice(F.sort_array(words), 1, 4), lambda x: x["w"])
    bare = F.concat(F.lit("unsignatured-"), F.substring(F.sha1(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), 1, 8))
    return F.when(F.size(longest) > 0, F.array_join(F.sort_array(longest), "-")).otherwise(bare)


def link_context(docs: DataFrame, width: int = 40) -> DataFrame:
    """``doc_id, target, context``: the first place of each wiki link with ``width`` characters on either side."""
    from loam.functions.text import links

    rows = docs.select("doc_id", "content", F.explode(links(F.col("content"))).alias("target"))
    at = F.expr("instr(content, concat('[[', target))")
    first = F.greatest(F.lit(1), at - width)
    rows = rows.where(at > 0)
    return rows.select("doc_id", "target", strip(F.translate(F.substring(F.col("content"), first, at + F.length("target") + 4 + width - first), "\n", " ")).alias("context"))
