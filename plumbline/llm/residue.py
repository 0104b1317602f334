"""Template residue, filler, error pages and scripts-required notices in short text fields.

Texts are brought to a message form (numbers, ids, addresses and dates masked, status codes of failed pages kept
apart, case and blanks evened out) and grouped by its hash across all sources and fields. Each distinct message is
judged once: by placeholder rules (syntax that only a slot has), by phrases that nothing else says, and by cues that
real remarks share, each of which is only evidence. A cue counts where the message recurs over several owners or
fields, where two different cues meet, where the message is about a page, file or browser, or where nothing but the
cue is said. The verdict goes back to the rows by the hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup

#: Rows, and distinct owners (bids) or fields among them, from which a message counts as widely recurring.
RECURS_ROWS, RECURS_OWNERS, RECURS_FIELDS = 3, 2, 2

#: Status codes of failed pages.
STATUS_CODES = "400|401|403|404|405|408|410|413|414|429|500|501|502|503|504"

#: What such pages say.
_FAILURES = (
    "page not found|not found|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|internal server error|forbidden|unauthori[sz]ed|"
    "file or directory missing|request time-?out|too many requests|method not allowed|server error|gone|payload too large"
)
#: Masks applied in this order to lower-case text; 0 stands for any number, 0x for an id, 404 for any status code.
MASKS = (
    (r"[\x{200b}-\x{200f}\x{2060}\x{feff}\x{ad}]", ""),
    (r"\s+", " "),
    (r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+", "url"),
    (r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", "mail"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "date"),
    (r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "0x"),
    (rf"(?<![\w.,/-])(?:{STATUS_CODES})(?= ?[-:]? ?(?:{_FAILURES})\b)|(?<=\b(?:http|error|status|code) )(?:{STATUS_CODES})\b", "#code#"),
    (r"[0-9]+([.,][0-9]+)*", "0"),
    (r"#code#", "404"),
    (r"^ | $", ""),
)

#: Names that forms give their slots, and words with which a slot asks to be filled.
_ASK = "enter|insert|add|type|fill in|your|input|provide|select|choose|specify|supply|put|replace with|name of"
_NAME = r"[a-z][a-z _/-]*"

#: What a slot in brackets is called by its last word.
_HEADINGS = (
    "name|names|number|no|date|price|rate|amount|address|phone|telephone|email|e-mail|title|description|company|architect|county|city|state|zip|quantity|qty|cost|"
    "initials|signature|contact|vendor|supplier|subcontractor|client|customer"
)

#: Words of Latin filler; three in a row are filler.
_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|"
    "quis|nostrud|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|"
    "pariatur|nunc|mauris|vitae|congue|semper|porta|vestibulum|pellentesque|curabitur|vivamus|praesent"
)

#: Slots still to be filled by a person or program.
SLOT_RULES = {
    "double braces": r"\{\{[^{}]*\}\}|\{%[^{}]*%\}",
    "dollar braces": r"\$\{[^{}]*\}|\$\([a-z_]+\)",
    "positional": r"\{0?\}|(?<![\w$])%\(?[a-z_]*\)?s(?![\w%])",
    "named braces": r"\{[a-z]+(?:[_ .][a-z0-9]+)*(?<=[a-z0-9_ .]{3})\}",
    "tag": r"<%=?[^<>]*%>|<\?=?[^<>]*\?>",
    "guillemets": rf"<<\s*{_NAME}\s*>>|«\s*{_NAME}\s*»",
    "percent": r"%%[a-z][a-z0-9_ ]*%%|@@[a-z][a-z0-9_ ]*@@|##[a-z][a-z0-9_ ]*##|__[a-z][a-z_]*[a-z]__",
    "double brackets": rf"\[\[\s*{_NAME}\s*\]\]",
    "asking brackets": rf"[<\[(]\s*(?:{_ASK})\s+(?:the |a |an )?{_NAME}(?: here)?\s*[>\])]",
    "bare ask": r"[<\[]\s*(?:enter|insert|fill in|type here|your input|specify|to be (?:filled|entered))\s*[>\]]",
    "named brackets": rf"[\[<]\s*(?:[a-z]+[ _/-]){{0,3}}(?:{_HEADINGS})(?: here)?\s*[\]>](?!\()",
    "asking later": r"[\[(<]\s*[^\[\](){}<>0]*\b(?:to (?:be (?:entered|added|completed|confirmed|determined|filled|supplied|advised|inserted|provided)|follow|complete|enter|supply|fill|confirm|come|provide|advise|insert)|fill in later|for input|awaiting [^\[\](){}<>]*|pending(?: [^\[\](){}<>]*)?|complete at [a-z]*0?)\b[^\[\](){}<>0]*0?\s*[\])>]",
    "bracketed unknown": r"[\[(<]\s*(?:t\.?b\.?[dca]\.?|x{2,}|_[_ ]*|\.{3,}|\?+)\s*[\])>]",
    "blank line": r"_{3,}|(?:_ ){2,}_|\.{6,}(?!\w)",
    "hashes": r"#{3,}",
    "crosses": r"(?<![\w-])x{2,3},x{3}(?![\w-])|(?<![\w-])x{4,}(?![\w-])|(?<![\w-])x{2,}\.x{2,}(?![\w-])|\$x{2,}",
    "to be": r"\bto be (?:completed|entered|determined|filled in)\b(?! (?:by|before|prior|within|after|when|in|on|at the|during|under|with|once)\b)|\bvalue to follow\b",
    "unknown": r"(?<![\w'\"‘“-])(?:t\.b\.[dca]\.|tb[dca])(?![\w'\"’”-])(?! (?:items?|lists?|logs?|entries|entry|was|were|by|is|closed|resolved|settled)\b)",
}

#: Filler text.
FILLER_RULES = {
    "latin": rf"\blorem ipsum\b|\b(?:{_LATIN}) (?:{_LATIN}) (?:{_LATIN})\b",
    "dummy": r"\b(?:dummy|sample|filler|placeholder|example) (?:text|line|note|entry|content|copy)\b(?! (?:approved|height))(?=.*\b(?:here|delete|remove|replace)\b|$| (?:dummy|sample|filler|placeholder))|\bdummy text\b",
    "prompt": r"\b(?:type|enter|write|add|put) (?:your )?(?:notes?|text|comments?|description)(?: text)? here\b|\byour (?:notes?|text|comments?|description) here\b|\b(?:text|notes?|content) goes here\b|\b(?:click|tap)(?: or tap)? (?:here )?to (?:enter|add|edit)\b|\breplace this (?:text|note|line)\b|\bdelete (?:this )?before (?:issue|issuing|sending)\b|\binsert (?:text|notes?) here\b",
    "keyboard": r"\b(test|foo|bar|blah|xyz|asdf|qwer|qwerty|abc|zxcv|dummy|hjkl)\b(?: \1\b)+|\b(?:asdf|qwer|zxcv|hjkl){2,}\b",
}

#: What stands before a number that is not a status code.
_PLACES = "room|rm|panel|door|suite|unit|area|item|sheet|line|level|floor|bldg|building|detail|note|lot|bay|pump|tag|mark|gate|no|space|stair|duct|circuit|ckt|circuits|key|part|model|type"

#: Messages of failed pages that real remarks don't use.
ERROR_RULES = {
    "status": rf"(?<!\b(?:{_PLACES})[ .:#-]{{1,2}})(?<![\w/.#-])(?:http |error |status )?404 ?[-:]? ?(?:{_FAILURES})(?! (?:on|in|at|by|during|from|since|when|after|before) )\b",
    "named status": rf"\b(?:http|error|status)(?: code)? 404\b|\b404 error\b|(?:^|[^\w/.#-])(?:http |error )0 ?[-:]? ?(?:{_FAILURES})\b",
    "title": r"<title>[^<]*(?:404|\b0\b|error|forbidden|not found)[^<]*</title>",
    "asked for": r"\b(?:page|file|document|resource|url|site|address) (?:that )?you (?:(?:have |had )?(?:asked for|requested|followed|typed|wanted|entered)|are (?:looking for|trying to))\b[^.]*\b(?:not|no longer|missing|removed|moved|n't)\b|\b(?:requested|following) (?:url|page|resource|file|document)\b[^.]*\b(?:not|no longer|missing|n't|unavailable)\b",
    "page": r"\bthis (?:page|link|url|web ?site) (?:is|was|has|does|has been|can|could|may)(?: not| no longer|n't|not| expired| moved)[^.]*|\b(?:this )?(?:web ?)?(?:page|site) (?:cannot|could not|can't|couldn't|can not) be (?:displayed|loaded|found|reached|opened)\b|\b(?:web )?page (?:is )?(?:not available|unavailable|no longer (?:available|exists)|does(?: not|n't) exist)\b",
    "session": r"\b(?:your )?session (?:has |is )?(?:expired|timed out)\b",
    "permission": r"\byou (?:do not|don't) have (?:the )?(?:permissions?|access|rights)\b|\bnot authori[sz]ed to (?:view|access|open)\b",
    "timeout": r"\brequest(?: 0x| \S*[0-9]\S*)? timed out\b|\b(?:connection|operation|server|gateway|database) timed out\b",
    "host": r"\b(?:server|host|dns|database) (?:error|connection|cannot be found|could not be (?:found|reached)|is(?: currently)? (?:unavailable|down|overloaded)|not responding)\b(?!s)|\bconnection (?:was )?(?:refused|reset)\b|\bunexpected (?:server )?error\b|\ban error (?:has )?occurr?ed\b",
}

#: Cues of failed pages that remarks about a site share: each is evidence only.
ERROR_CUES = {
    "unavailable": r"\b(?:temporarily|currently) unavailable\b|\bunavailable (?:right now|at (?:this|the) (?:time|moment))\b",
    "retry": r"\btry again(?: later| in a few| shortly)?\b|\bslow down and retry\b|\bretry (?:later|shortly)\b|\bplease (?:reload|refresh)\b",
    "again": r"\b(?:sign|log) (?:back )?in(?: again)?(?: to continue)?\b",
    "denied": r"\baccess (?:is |was )?(?:denied|forbidden)\b(?! (?:to|on|at|during|by|for)\b)",
    "missing": r"^[^a-z0-9]*(?:page |file |url |resource )?not found\b|\b(?:page|file|url|resource|link) (?:was )?not found\b",
    "sorry": r"\boops\b|\bwe(?:'re| are) sorry\b|^sorry\b|\bsomething went wrong\b|\bwent wrong\b",
    "many": r"\btoo many (?:requests|connections|redirects)\b",
    "maintenance": r"\b(?:down for|under|scheduled) maintenance\b|\bback (?:online|soon|shortly)\b",
    "invalid": r"\b(?:link|token|url|certificate) (?:is |has |was )?(?:invalid|expired|broken|no longer valid)\b",
}
#: Words of pages, browsers and servers, and the words between them.
_WEB = "page|pages|web|website|browser|server|servers|url|link|http|https|error|request|requests|session|login|username|password|cookies|portal|viewer|app|application|administrator|cache|captcha|token|html|plan room"
_SMALL = "a|an|the|this|that|it|is|are|was|be|been|has|have|had|to|for|of|in|on|at|and|or|not|no|we|you|your|our|please|sorry|again|later|now|right|moment|try|continue|view|here|back|soon|ref|id|code|while|with|by|then|there|do|does|can|could|if|or|later|retry|slow|down"

#: Notices that scripts are required.
SCRIPT_RULES = {
    "noscript": r"<noscript\b",
    "support": r"\b(?:browser|viewer|page|app|application|site)\b[^.]{0,30}\b(?:does not|doesn't|do not|must|cannot|can't) (?:support|run|allow|execute) (?:java ?)?scripts?\b",
    "enable": r"\b(?:enable|activate|turn on|switch on|allow|needs?|requires?)\b[^.]{0,24}\b(?:java ?scripts?|js|scripts|scripting)\b(?!-)(?! controlled)(?=[^.]{0,60}(?:$|\bto\b|\band\b|[.!]|\bin\b))",
    "required": r"\bjava ?script (?:is |must be |has to be )?(?:required|disabled|turned off|off|needed|enabled|not (?:enabled|supported|available))\b|\bwithout java ?scripts?\b",
    "off": r"\bscript(?:s|ing) (?:is |are |must be )?(?:disabled|turned off|off)\b|\bscripting disabled\b",
}

#: Cues of filler: any word three times or more and nothing else, and words that also name real samples.
FILLER_CUES = {"repeated word": r"^([a-z]{2,8})(?: \1){2,}$", "placeholder": r"^\W*(?:placeholder|filler|dummy|sample|example|test|testing)\W*$|^test (?:note|entry|record|line)\W*$"}


def message_form(text: Column) -> Column:
    """Lower-case text with numbers, ids, addresses and dates masked and blanks evened out."""
    return reduce(lambda t, m: F.regexp_replace(t, m[0], m[1]), MASKS, F.lower(text))


def _any(message: Column, rules: dict[str, str]) -> Column:
    return reduce(lambda a, b: a | b, [message.rlike(r) for r in rules.values()])


def judge(message: Column, rows: Column, owners: Column, fields: Column) -> Column:
    """Kind of residue of a message (slot, filler, error_page, scripts), null for real content.

    rows, owners, fields: how often the message occurs and over how many owners and fields.
    """
    recurs = (rows >= RECURS_ROWS) & ((owners >= RECURS_OWNERS) | (fields >= RECURS_FIELDS))
    cues = reduce(lambda a, b: a + b, [message.rlike(r).cast("int") for r in ERROR_CUES.values()])
    rest = reduce(lambda t, r: F.regexp_replace(t, r, " "), [*ERROR_CUES.values(), rf"\b(?:{_WEB}|{_SMALL})\b"], message)
    web = message.rlike(rf"\b(?:{_WEB})\b")
    words = F.size(F.regexp_extract_all(rest, F.lit("[a-z]{2,}"), F.lit(0)))
    error_cue = (cues >= 2) | ((cues == 1) & ((words == 0) | (recurs & web & (words <= 2))))
    return (
        F.when(_any(message, SCRIPT_RULES), "scripts")
        .when(_any(message, ERROR_RULES) | error_cue, "error_page")
        .when(_any(message, SLOT_RULES), "slot")
        .when(_any(message, FILLER_RULES) | (recurs & _any(message, FILLER_CUES)), "filler")
    )


def field_rows(df: DataFrame, tab: str, row_id: str, fields: list[str], owner: str) -> DataFrame:
    """tab, field_name, row_id, owner, text of the named text fields that hold something."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
    rows = df.select(F.lit(tab).alias("tab"), F.col(row_id).cast("bigint").alias("row_id"), F.col(owner).cast("string").alias("owner"), F.explode(each).alias("f"))
    return rows.select("tab", "f.field_name", "row_id", "owner", "f.text").where(F.trim("text") != "")


def messages(rows: DataFrame) -> DataFrame:
    """Distinct messages of `rows` (tab, field_name, row_id, owner, text): message, n_rows, n_fields, n_owners, kind.

    The counts run over all rows and sources; n_owners is the number of distinct hash buckets of owners, at
    most 64, which is all that the recurrence test needs. Kind is null for real content.
    """
    keyed = rows.select(message_form(F.col("text")).alias("message"), F.concat_ws(".", "tab", "field_name").alias("field"), F.pmod(F.xxhash64("owner"), F.lit(64)).cast("int").alias("bucket"))
    counted = keyed.groupBy("message").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.size(F.collect_set("field")).alias("n_fields"),
        F.expr("bit_count(bit_or(shiftleft(1L, bucket)))").alias("n_owners"),
    )
    return counted.withColumn("kind", judge(F.col("message"), F.col("n_rows"), F.col("n_owners"), F.col("n_fields")))


def residue(rows: DataFrame) -> DataFrame:
    """The fields that hold residue: tab, field_name, row_id, kind, n_rows (of the same message anywhere).

    Null, empty and blank fields and bare numbers are no residue. A text that holds residue beside real content
    counts. Repeated rows and ids give their row once. An empty input gives no rows.
    """
    cases = messages(rows).where("kind is not null").select(F.xxhash64("message").alias("key"), F.col("message").alias("judged"), "kind", "n_rows")
    cases = cases.groupBy("key").agg(F.collect_list(F.struct("judged", "kind", "n_rows")).alias("judged"))  # texts that share a 64-bit hash
    keyed = rows.select("tab", "field_name", "row_id", message_form(F.col("text")).alias("message")).withColumn("key", F.xxhash64("message"))
    found = salted_lookup(keyed, cases, ["key"], "row_id").withColumn("verdict", F.expr("filter(judged, x -> x.judged = message)[0]"))
    return found.where("verdict is not null").select("tab", "field_name", "row_id", "verdict.kind", "verdict.n_rows").dropDuplicates(["tab", "field_name", "row_id"])


def clean(df: DataFrame, found: DataFrame, tab: str, row_id: str, field: str) -> DataFrame:
    """`df` with `field` set to null where it was found to hold residue."""
    hits = found.where((F.col("tab") == tab) & (F.col("field_name") == field)).select(F.col("row_id").alias("__hit")).distinct()
    joined = df.join(hits, df[row_id] == F.col("__hit"), "left")
    return joined.withColumn(field, F.when(F.col("__hit").isNull(), F.col(field))).drop("__hit")
