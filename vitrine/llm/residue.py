"""Template residue, filler, error-page and scripts-required messages.

Messages are masked (numbers, addresses, dates, blanks, case) and grouped by an exact hash
of the masked form across sources; so are their segments, the parts between separators,
as a notice often stands beside a shop's name. Each distinct form and segment is
classified once, by rules of two strengths:

* firm rules read a template's syntax, or a notice's grammar (what is wrong, with what;
  what must be switched on). They hold wherever they match.
* soft rules name wordings that are also ordinary copy ('access denied', 'add your
  headline'). They count for a whole segment only, and only if the segment recurs at
  RECURS sources or more: platforms repeat themselves across shops, a shop's line doesn't.

A message cut short ends in the beginning of a known recurring message; such endings are
looked up by hash. Flags go back to the records by hash.

Defined results: null and blank messages are no cases; a null source counts as one source;
texts of any length are read whole; repeated records are flagged alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import blank_free, checkpointed, lookup_join

#: Sources at which a segment must be seen to count as recurring.
RECURS = 3
#: A cut segment keeps this share of the message it comes from, and so many characters at least.
CUT_SHARE, CUT_LEAST = 0.6, 10

# What templates put between their delimiters.
_ID = r"[a-z_$][\w$]*"
_PATH = rf"{_ID}(?:(?:\.|->|::|_){_ID})+"
_FIELD = r"(?:brand|category|collection|discount|name|title|headline|heading|product|price|city|date|season|offer|banner|shop|store|url|text|code|amount|percent|pct|status|customer|first_?name|last_?name|email|link|image|subtitle|placeholder|value|count|user|item|page)"
_SLOT = rf"(?:{_PATH}|{_FIELD}|#)"
_MARKUP = r"(?:a|b|br|div|em|h#|hr|i|img|li|ol|p|s|small|span|strong|sub|sup|u|ul)"

#: Syntax that is left of a template.
SYNTAX = {
    "braces": r"\{\{|\}\}",
    "tags": r"\{%|%\}|<%|%>|\[%|%\]|<\?(?:php|=)|\?>",
    "prefixed_brace": rf"[$#%@!]\{{\s*{_ID}",
    "double_brackets": rf"\[\[\s*{_ID}|<<\s*{_ID}|\(\(\s*{_ID}\s*\)\)",
    "merge_tag": rf"\*\|\s*{_ID}",
    "doubled_signs": rf"(?<![\w%#])(~~|%%|@@|##|\|\||\$\$|\^\^)\s*{_ID}(?:[.\w]*\s*\1)|(?<![\w%])(?:%%|@@){_ID}|(?<!\w)__[a-z][\w.]*",
    "single_signs": rf"(?<![\w#%])%(?:{_FIELD}|{_PATH})%?(?!\w)|(?<![\w$])\$[a-z_]\w*(?:\.\w+)*\$|(?:^|\s)@(?:model|viewbag|viewdata|html|resources?|config|page)\.\w+",
    "angle": rf"<(?!/?{_MARKUP}\b){_SLOT}>|<(?!{_MARKUP}$)[a-z][a-z_.]*$",
    "single_brace": rf"\{{{_SLOT}\}}|\{{(?:{_PATH}|[a-z_.]*)$",
    "bracket": rf"\[(?:{_PATH}|{_FIELD}|{_ID}\.)(?:\]|$)",
    "printf": r"%(?:\(\w+\)|#\$)?[sd](?![a-z#])",
    "object": r"\[object",
    "resource_key": rf"(?:^|[\s|:–-])(?!www\.)[a-z]\w*(?:\.[a-z_]\w*){{2,}}(?<!\.(?:com|net|org|shop|store|example|uk|de|fr|es|pt|eu))(?=[.…!?]*(?:$|[\s|]))|translation[ _]missing|missing translation",
    "empty_value": r"(?:undefined|null|\bnan)\s?%|(?:total|price|from|£|\$|€)[:\s]*(?:nan|undefined|null)\b|#(?:ref|n/a|value|name|num|div/#)[!?]",
    "exception": rf"\b(?:uncaught|unhandled|traceback)\b|\b[a-z]{{3,}}(?:error|exception)\b:?|\b(?:fatal|parse|syntax|liquid|template|runtime|type|reference|compile) (?:error|exception)\b|\b(?:warning|notice|error|exception): (?:undefined|cannot|can't|could not|failed|unable|invalid|unexpected|no such|unknown|missing)|cannot read propert|undefined (?:variable|index|property|method)|(?<!\w)\${_ID} on line #",
}

# The vocabulary of notices: what is concerned, and what is wrong with it.
_PAGE = r"(?:web ?page|page|web ?site|site|shop|store|url|address|domain|host|server|service|application|account|resource|content|file|seite|página|pagina|página solicitada|page demandée|boutique|tienda|loja|sitio|dirección|site web)"
_GONE = (
    r"(?:(?:was |is |are |be |were |could ?n[o'’]?t be |can ?n?[o'’]?t be )?(?:not |never )found|(?:can(?:no|'|’)t|cannot|could ?n[o'’]?t|could not|can not) be (?:found|reached|displayed|loaded|opened|located)|does ?n[o'’]?t exist|does not exist|no longer (?:exists?|available)|has (?:been )?(?:moved|removed|deleted|suspended|expired|disabled|wandered)"
    r"|is(?:n't| not| currently not) (?:available|configured|responding|working)|is (?:currently |temporarily |now )?(?:unavailable|offline|suspended|parked|down(?= for\b|[.!]?$))|not (?:configured|published|available)|unavailable|failed to load"
    r"|n'existe (?:pas|plus)|introuvable|nicht gefunden|existiert nicht|nicht (?:verfügbar|erreichbar)|no (?:existe|encontrad[ao]|se encontró|disponible)|não (?:encontrad[ao]|existe|disponível)|non (?:trovata|esiste)|niet gevonden)"
)
_FAULT = r"(?:error|exception|fehler|erreur|errore|erro|fout)"
_SCRIPT = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b|noscript)"
_ENABLE = r"(?:enabl|(?:turn|switch)(?:ed)? (?:\w+ )?o[nf]|activ|allow|need|requir|disabl|block|support|\brun\b|aktivier|benötig|erforderlich|deaktivier|habilit|ativ[ea]|desactiv|désactiv|necesit|requier|nécessi|attiv|abilit|schakel|vereist|nodig|\boff\b)"
_SOFTWARE = r"(?:robots?|bots?|humans?|browser|humain|navigateur|mensch|humano|navegador|roboter)"
_NOUN = r"(?:headline|heading|subheading|title|subtitle|text|copy|strapline|tagline|caption|story|content|description|paragraph|words|banner|image|slogan)"

#: What a page says in place of its content, as combinations that ordinary copy doesn't use.
NOTICES = {
    "latin": r"(?:\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|dolore|aliqua|enim|minim|veniam|quis|nostrud|ullamco|laboris|aliquip|commodo|duis|aute|irure|voluptate|velit|cillum|fugiat|pariatur|excepteur|occaecat|cupidatat|proident|culpa|officia|deserunt|mollit|laborum)\b[ ,.]*){2,}",
    "sample": rf"\b(?:sample|dummy|placeholder|example|demo)\b (?:\w+ )?(?:{_NOUN}|product|page|post)\b|\b(?:replace|remove|delete) (?:before|this (?:text|copy|line)|me\b)|platzhalter|blindtext|mustertext|beispieltext|text[eo] (?:de (?:remplacement|ejemplo|exemplo|relleno)|d'exemple|à venir|provisional)",
    "to_come": rf"(?:^|[|:–-] ?)(?:todo|fixme)\b|\b{_NOUN} (?:needed|to (?:follow|come|be (?:added|confirmed|supplied)))(?=[\s.…!?:(]*(?:$|[|–-])|[:.,;])|\b{_NOUN} goes (?:here|in here)\b(?! [-–—|]? ?\w)|\b{_NOUN} goes here(?= ?[|–-])|\b(?:ihr|dein|votre|ton|tu|su|seu|il tuo) (?:text|titel|texte|titre|texto|título|testo)\b.{{0,3}}(?:hier|ici|aqu[ií]|qui)|hier (?:steht|kommt) (?:ihr|dein)",
    "http": rf"(?:^|[\s|:–(-])# ?[-:|–]? ?(?:(?:web ?)?page )?(?:not found|bad gateway|bad request|internal server|service (?:temporarily )?unavail|backend fetch|gateway time|forbidden|unauthori[sz]ed|too many requests|request time)|\b(?:http|{_FAULT})(?: error| status| code)?[ #:(-]*#(?! ?%)|bad gateway|bad request|internal server error|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|backend fetch failed|too many requests|upstream (?:request|connect|server)|request (?:has )?timed? ?-?out|method not allowed|temporarily unavailable",
    "page_gone": rf"\b{_PAGE}\b[\w' ,]{{0,25}}?\b{_GONE}|(?:not found on this server|no se encontró (?:la|el|esta)|couldn['’]t find (?:the|that|what you)|(?:can['’]t|cannot|could not|can['’]t seem to) find (?:the|that|this|what you))",
    "fault": rf"\b(?:unexpected|unknown|internal|application|client-side|server-side|critical|unerwarteter|interner|inattendue?|interne|inesperado|inesperada) {_FAULT}\b|\b{_FAULT} (?:has )?(?:occurred|establishing|while|loading|processing|inattendu\w*|inesperad\w*|ist aufgetreten|est survenue|s'est produite)|\b(?:application|server|database|system) {_FAULT}\b|(?:something|it) went wrong(?=\.? ?(?:please|try|on our|$)|[.:!])|an? (?:\w+ )?exception has occurred|une erreur (?:\w+ )?(?:est|s'est)|ein (?:\w+ )?fehler ist|(?:se ha producido|ha ocurrido|ocurrió|ocorreu|aconteceu) (?:un|um) err|si è verificato|{_FAULT}: [a-z ]*(?:cannot|failed|unable|not found|invalid)",
    "retry": r"\bplease (?:try again|reload|refresh)\b|\btry again (?:later|in a (?:few|moment|minute))|\b(?:reload|refresh) (?:the|this) page\b",
    "connection": r"\b(?:connection|session|request|operation|token|server|database) (?:has |have |was |is |been )*(?:timed? ?-?out|blocked|expired|reset|refused|denied|failed|aborted|closed|invalid)|database connection|no such (?:file|host|key|bucket|table)|permission denied",
    "refused": r"access (?:to [\w ]{1,30} )?(?:is|was|has been) denied|\b(?:you )?(?:do ?n[o'’]?t|do not) have (?:permission|access|the rights)|\bnot authori[sz]ed to\b|\brate limit(?:ed)?\b|unusual traffic|captcha|ddos protection|attention required",
    "check": rf"\b(?:check|verif|confirm|prov|vérifi|überprüf|prüf|comprob|security check)\w*\b.{{0,40}}\b{_SOFTWARE}\b|\b(?:are you|you are|you're) (?:not )?(?:a )?(?:robot|human)\b|\bsecurity check\b|\bbrowser is (?:not supported|out of date|outdated|no longer supported)",
    "maintenance": r"\b(?:down|closed|offline|unavailable|undergoing|performing|scheduled|planned|under|en|em|in|une) (?:for )?(?:scheduled |planned |routine |essential )?(?:maintenance|mantenimiento|manutenção|manutenzione|wartung)\b(?!\?)|wartungsarbeit|\b(?:site|website|page) (?:is )?under construction",
    "scripts": rf"{_SCRIPT}.{{0,40}}{_ENABLE}|{_ENABLE}.{{0,40}}{_SCRIPT}|(?:turn|switch)(?:ed)? {_SCRIPT} o[nf]|\bnoscript\b|\b(?:enable|allow|accept|turn on|activ\w+|requiere|nécessite) (?:\w+ ){{0,2}}cookies\b",
}

#: Wordings that are ordinary copy too: whole recurring segments only.
SOFT = (
    rf"undefined|null|nan|none|n/a|tbc|tbd|tba|access denied|forbidden|unauthori[sz]ed|(?:page |file |site )?not found|(?:internal )?server error|error|loading|please wait|just a moment|one moment|redirecting|coming soon|be (?:right )?back (?:shortly|soon)|under construction|maintenance(?: mode)?"
    rf"|untitled(?: (?:page|document))?|home ?page title|default title|placeholder|object object|(?:test|tk|asdf|foo|bar|qwerty|blah)(?: (?:test|tk|asdf|foo|bar|blah|#))*|(?:x{{2,}} ?)+|(?:rich|image with) text|text block|featured (?:collection|product)|talk about your brand"
    rf"|(?:please )?(?:add|insert|type|enter|write|put|edit|tell|share|use|change|describe) .{{0,30}}\b{_NOUN}(?: here)?|(?:add|insert|type|enter|write|put|edit|tell|share|describe)\b.{{3,50}}\bhere|your {_NOUN}(?: (?:text|here|goes))*|(?:{_NOUN}) (?:goes )?here|{_NOUN}"
)


def masked(c: Column) -> Column:
    """Lower case, blanks folded, dates, addresses and numbers as '#'; straight quotes."""
    low = F.translate(F.lower(blank_free(c)), "’‘", "''")
    low = F.regexp_replace(low, r"https?://\S+|\bwww\.\S+", "@url")
    low = F.regexp_replace(low, r"\d{4}-\d\d-\d\d(?:t[\d:.]+z?)?|\d{1,2}[./]\d{1,2}[./]\d{2,4}", "#")
    return F.regexp_replace(low, r"\d+", "#")


def segments(m: Column) -> Column:
    """The parts of a masked message between bars and spaced dashes, and what follows a part's first colon; marks around them off. Each once."""
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?:\s*(?::\(|:\)|…|[.!?]+))+$", ""), r"^[\s.!?…]+", ""))
    parts = F.split(m, r"\s*\|\s*|\s+[–—-]\s+")
    after = F.transform(F.filter(parts, lambda s: s.contains(": ")), lambda s: F.regexp_replace(s, r"^.*?:\s+", ""))
    return F.array_distinct(F.filter(F.transform(F.concat(parts, after), bare), lambda s: s != ""))


def _any(rules: dict[str, str]) -> str:
    return "|".join(f"(?:{r})" for r in rules.values())


def firm(m: Column) -> Column:
    """'placeholder' or 'notice' where a firm rule matches a masked text, else null."""
    # 'doubled_signs' refers to a group of its own, so it is tried apart
    signs = SYNTAX["doubled_signs"]
    rest = {k: r for k, r in SYNTAX.items() if k != "doubled_signs"}
    return F.when(m.rlike(_any(rest)) | m.rlike(signs), F.lit("placeholder")).when(m.rlike(_any(NOTICES)), F.lit("notice"))


def messages(df: DataFrame, item: str, source: str, fields: dict[str, Column]) -> DataFrame:
    """(item, source, message_hash, message): a row per record and distinct field text; no text work is done here."""
    rows = df.select(F.col(item).alias("item"), F.col(source).alias("source"), F.explode(F.array_compact(F.array_distinct(F.array(*fields.values())))).alias("message"))
    return rows.withColumn("message_hash", F.xxhash64("message"))


def masked_texts(rows: DataFrame) -> DataFrame:
    """(message_hash, message, source, n_rows, form_hash, masked): distinct texts of each source with their masked forms.

    Distinct texts are found by hash aggregation before anything is masked, so the masks don't
    see each row. The generator keeps the optimiser from working a masked form out again for every use.
    """
    texts = rows.groupBy("message_hash", "message", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    return texts.select("*", F.explode(F.array(masked(F.col("message")))).alias("masked")).withColumn("form_hash", F.xxhash64("masked")).filter("masked <> ''")


def form_groups(texts: DataFrame) -> DataFrame:
    """(form_hash, masked, n_rows, n_sources, verdict): masked forms grouped by their hash across sources, each put to the firm rules once."""
    per_source = texts.groupBy("form_hash", "masked", "source").agg(F.sum("n_rows").alias("n_rows"))
    groups = per_source.groupBy("form_hash", "masked").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"))
    return groups.select("*", F.explode(F.transform(F.array("masked"), firm)).alias("verdict"))


def segment_groups(texts: DataFrame) -> DataFrame:
    """(segment, n_sources, verdict): the segments of all messages with the sources that show them; verdict 'notice', 'placeholder', 'soft' or null.

    A segment of a text counts once a source, whatever its rows. The firm verdict holds for the segment alone.
    """
    flat = texts.select("source", F.explode(segments(F.col("masked"))).alias("segment"))
    groups = flat.groupBy("segment", "source").agg(F.lit(1).alias("one")).groupBy("segment").agg(F.count(F.lit(1)).alias("n_sources"))
    verdict = lambda s: F.coalesce(firm(s), F.when(s.rlike(f"^(?:{SOFT})$"), "soft"))
    return groups.select("*", F.explode(F.transform(F.array("segment"), verdict)).alias("verdict"))


def bad_segments(groups: DataFrame) -> DataFrame:
    """(segment): segments that are no content by themselves: soft ones that recur, and ends of cut messages that begin like a recurring notice."""
    recurring = groups.filter((F.col("n_sources") >= RECURS) & F.col("verdict").isNotNull())
    soft = recurring.filter("verdict = 'soft'").select("segment", F.lit(False).alias("cut"))
    least = F.greatest(F.lit(CUT_LEAST), F.ceil(F.length("segment") * CUT_SHARE).cast("int"))
    cuts = recurring.filter(F.length("segment") > least).select(F.explode(F.transform(F.sequence(least, F.length("segment") - 1), lambda n: F.rtrim(F.substring(F.col("segment"), F.lit(1), n)))).alias("segment"))
    # only beginnings that occur, and that don't recur widely themselves as something else
    seen = groups.filter("verdict IS NULL OR verdict = 'soft'").select("segment", "n_sources")
    ends = seen.join(cuts.distinct(), "segment", "left_semi").select("segment", F.lit(True).alias("cut"))
    return soft.unionByName(ends).groupBy("segment").agg(F.min("cut").alias("cut"))


def classified(texts: DataFrame) -> DataFrame:
    """(form_hash, masked, n_rows, n_sources, verdict): every masked form with its class: 'placeholder', 'notice', 'recurring', 'cut', or null for content."""
    forms = checkpointed(form_groups(texts))
    bad = checkpointed(bad_segments(checkpointed(segment_groups(texts))))
    # the last segment is the one that a cut can shorten
    parts = forms.filter("verdict IS NULL").select("form_hash", "masked", F.posexplode(segments(F.col("masked"))).alias("pos", "segment"))
    parts = parts.withColumn("ends", F.endswith("masked", "segment"))
    hit = lookup_join(parts, bad, ["segment"]).filter("NOT cut OR ends")
    found = hit.groupBy("form_hash", "masked").agg(F.when(F.min("cut"), "cut").otherwise("recurring").alias("by_segment"))
    joined = forms.join(found, ["form_hash", "masked"], "left")
    return joined.select("form_hash", "masked", "n_rows", "n_sources", F.coalesce("verdict", "by_segment").alias("verdict"))


def flagged_messages(rows: DataFrame) -> DataFrame:
    """(message_hash, message): the distinct messages that are no content, kept."""
    texts = checkpointed(masked_texts(rows))
    bad = checkpointed(classified(texts).filter("verdict IS NOT NULL").select("form_hash", "masked"))
    return checkpointed(lookup_join(texts, bad, ["form_hash", "masked"]).select("message_hash", "message").distinct())


def flagged_items(rows: DataFrame) -> DataFrame:
    """(item): records with at least one message that is no content."""
    bad = flagged_messages(rows)
    return lookup_join(rows.select("item", "message_hash", "message"), bad, ["message_hash", "message"]).select("item").distinct()


def recurrence(rows: DataFrame) -> DataFrame:
    """(masked, verdict, n_rows, n_sources): the forms that are no content, and with a null verdict those that no rule knows but RECURS sources or more show."""
    return classified(checkpointed(masked_texts(rows))).filter((F.col("n_sources") >= RECURS) | F.col("verdict").isNotNull()).select("masked", "verdict", "n_rows", "n_sources")
