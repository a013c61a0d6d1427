"""Problem 9: template residue, filler, error pages and script notices among the notes.

Every paragraph is masked in the pass that reads it: unfilled fields by the placeholder rules, then e-mail and
web addresses, then numbers, dates and times. Equal masked paragraphs are one group, by two independent 64-bit
hashes (128 bits, so that groups of 10^11 paragraphs don't meet by chance), counted over all documents, sources
and languages. A group is residue

* if it recurs widely: over two sources or more and over the languages of the notes around it, as no
  clinician's sentence does, since that is written in the language of its note. Headings, quotations and
  single words recur so without being messages and are left out;
* if a masked field stands in it;
* if every sentence of it is one that a system or a template writes (phrase rules). These label the groups that recur
  and decide those that were met once;
* if it is filler in invented words: the words that stand beside "lorem ipsum" and hardly anywhere else.

Rules are anchored at the start of a sentence and have no nested repetition, so a paragraph costs time in
proportion to its length. All are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import spread, table, written

#: Names that template fields have; a bare word in guillemets is a placeholder only if it is one of these
#: or is joined by an underscore or point.
FIELD_NAMES = "name|date|dose|ward|provider|patient|allergies|diagnosis|findings|follow_up|visit_date|visitdate|dx_primary|patient_name|signature|address|phone|age|sex"
#: Words that tell a writer to fill something in.
FILL_WORDS = "insert|enter|choose|select|fill|add|specify|complete|type|pick|placeholder|insertar|completar|rellenar|elegir|indicar|insérer|compléter|choisir|indiquer|saisir|eintragen|einsetzen|einfügen|ausfüllen|auswählen|wählen|указать|вставить|заполнить|выбрать|συμπληρώστε|εισάγετε|επιλέξτε|填写|插入|选择|请填|入力|記入|選択|挿入|أدخل|اكتب|اختر|दर्ज|भरें|चुनें|ใส่|กรอก|เลือก"
#: A field's name in any alphabet, of any length within its line, with filters behind bars.
_WORD = r"[\p{L}_][\p{L}\p{M}\p{N}_.]*"
_FIELD = r"[\p{L}_][\p{L}\p{M}\p{N}_.\- ]*+(?:\|[^{}<>\[\]\n%]*+)?"
PLACEHOLDER = r"(?=[{$#<\[%@«_&（【*A-Z])(?:" + "|".join([
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}", rf"[$#]\{{\s*{_FIELD}\}}", rf"<<\s*{_FIELD}>>", rf"\[\[\s*{_FIELD}\]\]",
    rf"\{{%\s*{_FIELD}%\}}", rf"<%=?\s*{_FIELD}%>", rf"%%{_WORD}%%", rf"%\({_WORD}\)[sdf]", rf"@@{_WORD}@@",
    r"\$[A-Z][A-Z_]+\$", r"\{[A-Za-z_][\w.]*\}", r"\{\d\}", r"&lt;[\p{L}_][\p{L}\p{M}\p{N}_. ]*&gt;",
    rf"«(?:{FIELD_NAMES}|[a-z]+(?:[_.][a-z]+)+)»", r"_{5,}", r"\bTBD(?:_\w+)?\b", r"\b[A-Z]+_FILL_IN\b",
    # stars in a word's place, dates of letters, names of fields in single brackets
    r"(?<=[\p{L}:,] )\*{3,}(?=[\s.,;:)]|\z)", r"\b(?:XX|DD|MM|TT|JJ)([/.\-])(?:XX|DD|MM)\1(?:X{2,4}|Y{2,4}|J{2,4}|A{2,4})\b",
    rf"<(?:{FIELD_NAMES}|[a-z]+(?:[_.][a-z]+)+|\p{{L}}+(?: \p{{L}}+)+)>", r"\[[A-Z]+(?:_[A-Z]+)+\]",
    rf"(?iu)[\[<（【［][^\[\]<>\n]{{0,60}}(?<![\p{{L}}])(?:{FILL_WORDS})(?![\p{{Ll}}])[^\[\]<>\n]{{0,60}}[\]>）】］]",
]) + ")"

_NOUN = r"(?:(?:requested|chart|clinical|medical|patient)\s)*(?:document|record|note|letter|page|chart|file|form|report|result|section|site|service|viewer)"
_FAILED = r"(?:(?:has |have )?failed to (?:load|open|render)|(?:could|can) ?not be (?:opened|loaded|located|found|shown|displayed|rendered|reached)|(?:was|is) not (?:found|available)|(?:has )?timed out|(?:is|are) (?:no longer|temporarily|currently|not) available|is (?:temporarily |currently )?unavailable|(?:did|does) not (?:answer|respond|exist|load)|has expired|has been (?:removed|moved)|is missing)"
_SCRIPT = r"(?:java\s?scripts?|scripts?|cookies?)(?: (?:and|or|&) (?:java\s?scripts?|scripts?|cookies?))?"
#: Whole sentences (masked, lower case, without end mark) that a system writes and no clinician does.
ERRORS = [
    r"(?:system |internal |server )?(?:error|fault|err|status|http|http error|http status|exception|fehler|ошибка|erreur|σφάλμα|errore?|código|fehlercode|错误|エラー|خطأ|त्रुटि|ข้อผิดพลาด)\.?(?: code| no\.?| number)?\s?[.:#]?\s?[#(]?0\)?",
    rf"(?:(?:the|this|your|that) )?{_NOUN}(?: service)? {_FAILED}(?: (?:while|when) loading| on (?:this|the) server| in time| at this time| right now)?",
    r"(?:page|document|record|note|file)s? not found", r"page introuvable", r"access (?:is )?(?:denied|forbidden)", r"(?:your )?session (?:has )?(?:expired|timed out|ended)",
    r"(?:please )?(?:sign|log) in again(?: to (?:view|open|see|continue) ?[\w ]*)?", r"(?:please )?(?:try again|retry)(?: later)?(?: or contact [\w ]+)?",
    r"internal (?:server )?error(?: (?:while|when) [\w ]+)?", r"(?:bad )?gateway(?: timeout)?(?: (?:while|when) [\w ]+)?", r"service (?:is )?(?:temporarily |currently )?unavailable(?: \(?0\)?)?",
    r"0 (?:bad gateway|gateway timeout|not found|forbidden|unauthori[sz]ed|internal server error|service unavailable|too many requests|bad request)", r"unexpected (?:null|end|error|token|empty) ?(?:of )?[\w ]{0,20}", r"traceback(?: \(most recent call last\))?:?.{0,80}", r"[\w.]*(?:error|exception)(?: in|:) [\w ]{1,60}",
    r"your (?:role|account|user) lacks the (?:right|permission)s? to [\w ]+(?: \(ref 0\))?", r"you (?:do not|don't) have (?:permission|access|the right)s? [\w ]*",
    r"die seite (?:konnte nicht|kann nicht) (?:geladen|gefunden|angezeigt) werden", r"seite nicht gefunden", r"zugriff verweigert", r"(?:ihre )?sitzung (?:ist )?abgelaufen",
    r"(?:la )?página no (?:encontrada|disponible|se pudo cargar|se puede mostrar)", r"no se (?:pudo|puede) (?:cargar|abrir|mostrar) [\w ]+", r"acceso denegado", r"(?:la )?sesión (?:ha )?(?:expirado|caducado|expirada|caducada)",
    r"accès (?:refusé|interdit)", r"(?:la |votre )?session (?:a )?expirée?", r"impossible d(?:e |')(?:charger|ouvrir|afficher) [\w ]+", r"(?:la )?page (?:est )?(?:indisponible|inaccessible)|(?:la )?page n(?:e |')(?:peut|a) [\w ]+",
    r"доступ (?:к [\p{L} ]+ )?(?:запрещ[её]н|закрыт)", r"(?:страница|запись|документ) не (?:найдена?|загружена?|доступна?|загрузил[са]+[сь]*)", r"не удалось (?:загрузить|открыть|показать) [\p{L} ]+", r"сеанс (?:истёк|истек|завершён)",
    r"η σελίδα δεν [\p{L} ]+", r"(?:页面|文档|记录|病历)(?:加载失败|不存在|未找到|无法(?:打开|显示|加载))", r"(?:访问被拒绝|拒绝访问|会话已过期|服务暂时不可用)",
    r"(?:ページ|文書|記録|ファイル)(?:を(?:表示|読み込み|開くことが)できません(?:でした)?|が見つかりません(?:でした)?|は存在しません)", r"(?:アクセスが拒否されました|セッションの?有効期限が切れました|サービスは一時的に利用できません)",
    r"(?:الصفحة غير موجودة|تعذر تحميل الصفحة|تم رفض الوصول)", r"(?:पृष्ठ नहीं मिला|पृष्ठ लोड नहीं हो सका)", r"(?:ไม่พบหน้า|ไม่สามารถโหลดหน้า)[\p{L}\p{M}]*",
]
SCRIPTS = [
    rf"{_SCRIPT} (?:are|is|must be|has to be|have to be|need to be) (?:blocked|disabled|off|turned off|required|needed|enabled|allowed|turned on|switched on)(?:,? (?:so|to|for|in|before|and) [\w ]+)?",
    rf"(?:please )?(?:enable|allow|activate|turn on|switch on|accept) {_SCRIPT}(?: (?:to|in|and|for|before) [\w ]+)?", rf"(?:please )?(?:turn|switch) {_SCRIPT} on(?: (?:to|in|and|for) [\w ]+)?",
    rf"(?:this|the|your|our) [\w ]{{1,40}}(?:needs?|requires?|uses) {_SCRIPT}(?: [\w ]+)?", r"checking (?:your|the) browser(?: before [\w ]+)?", rf"you need to (?:enable|allow) {_SCRIPT}(?: [\w ]+)?", rf"your browser (?:does not support|has disabled|blocks) {_SCRIPT}",
    r"(?:bitte )?aktivieren sie (?:java\s?script|cookies|skripte)[\p{L}, ]*", r"(?:java\s?script|cookies|skripte) (?:ist|sind|muss|müssen) [\p{L} ]+", r"(?:veuillez )?activer? (?:java\s?script|les cookies|les scripts)[\p{L}' ]*|veuillez activer [\p{L}' ]*(?:java\s?script|cookies|scripts)[\p{L}' ]*",
    r"(?:por favor,? )?(?:active|habilite|active|permita) (?:java\s?script|las? cookies|los scripts)[\p{L} ]*", r"(?:пожалуйста,? )?(?:включите|разрешите) (?:java\s?script|скрипты|cookies?|сценарии)[\p{L} ,]*", r"ενεργοποιήστε (?:την? |τα )?(?:java\s?script|cookies)[\p{L} ]*",
    r"请(?:启用|开启|允许)(?:脚本|java\s?script|cookies?)[\p{L}]*", r"(?:スクリプト|java\s?script|クッキー)を有効にして[\p{L}]*", r"يرجى تفعيل [\p{L} ]*(?:java\s?script|الكوكيز|البرامج النصية)[\p{L} ]*", r"(?:कृपया )?(?:java\s?script|जावास्क्रिप्ट|कुकीज़)[\p{L}\p{M} ]* सक्षम [\p{L}\p{M} ]*", r"(?:กรุณา|โปรด)เปิดใช้[\p{L}\p{M}]* ?(?:java\s?script|คุกกี้|สคริปต์)[\p{L}\p{M} ]*",
]
FILLER = [
    r"\[?(?:placeholder|dummy|sample|filler|example)(?: (?:narrative|text|note|paragraph|content))+\]?(?: goes here| here| only)?", r"this is (?:a |an |only )?(?:dummy|placeholder|sample|test|filler|example) (?:note|text|document|paragraph|record)(?: (?:for|to) [\w ]+)?",
    r"(?:your |the |main |body )?(?:text|note|content|findings) (?:goes |comes )?here", r"(?:please )?(?:replace|delete|overwrite|remove) this (?:paragraph|text|note|section|line)(?: before [\w ]+)?", r"please ignore(?: this (?:note|text|message))?",
    r"(?:test[ ,]*){2,}", r"(?:(?:asdf|jkl|qwer|qwerty|asd|sdf|jklö|hjkl|zxcv|foo|bar|baz|bla|blah)[ ,]*){2,}", r"(?:(\p{L})\1{2,})(?:[ ,]+(\p{L})\2{2,})+", r"lorem ipsum.*",
    r"(?:dies ist (?:ein )?)?(?:blindtext|platzhaltertext|fülltext|beispieltext|mustertext)(?:,? bitte [\p{L} ]+| hier [\p{L} ]+)?", r"(?:hier )?(?:bitte )?text (?:hier )?(?:einfügen|eingeben|eintragen)",
    r"texte (?:de remplissage|d'exemple|factice|fictif|provisoire)(?:,? (?:à|avant|pour) [\p{L} ]+)*", r"(?:saisir|insérer|votre) (?:le |votre )?texte ici", r"texto de (?:ejemplo|relleno|prueba|muestra)(?:,? (?:sustituir|reemplazar|cambiar|borrar|eliminar)[\p{L} ]*)?", r"(?:escriba|inserte|su) (?:el |su )?texto aquí",
    r"(?:пример текста|текст-заполнитель|образец текста|введите текст)(?:,? [\p{L} ]+)?", r"(?:κείμενο (?:δείγμα|υπόδειγμα|πλήρωσης))(?:,? [\p{L} ]+)?", r"(?:此处|在此|请在此)(?:填写|输入|插入)(?:内容|正文|文本|文字)", r"(?:示例文本|占位文本|测试文本)[\p{L}，]*", r"ここに(?:本文|文章|テキスト|内容)を?(?:入力|記入|挿入)(?:してください)?", r"(?:ダミー|サンプル)(?:テキスト|文章)[\p{L}、]*",
    r"(?:نص تجريبي|أدخل النص هنا|نص بديل)[\p{L} ،]*", r"(?:नमूना पाठ|यहाँ पाठ लिखें|यहां पाठ लिखें)[\p{L}\p{M} ]*", r"(?:ข้อความตัวอย่าง|ใส่ข้อความที่นี่|พิมพ์ข้อความที่นี่)[\p{L}\p{M} ]*",
]


def _numbered(rules: str) -> str:
    """Backreferences of a rule count from the start of the whole pattern: name them instead."""
    return rules.replace(r"(\p{L})\1{2,}", r"(?<la>\p{L})\k<la>{2,}").replace(r"(\p{L})\2{2,}", r"(?<lb>\p{L})\k<lb>{2,}")


_RULES = _numbered("|".join(f"(?:{rule})" for rule in (*ERRORS, *SCRIPTS, *FILLER)))
#: How a message begins: the only test that most paragraphs undergo.
BEGINS = rf"\A(?:(?:[-*•]|0[.)])\s+)?(?:{_RULES})"
#: A whole sentence of filler, and of any message.
_FILLED = rf"\A(?:{_numbered('|'.join(f'(?:{rule})' for rule in FILLER))})\z"
SENTENCE = rf"\A(?:{_RULES})\z"
BULLET = r"\A(?:[-*•]|0[.)])\s+"
#: Points that end no sentence.
SHORTENED = r"\b(err|no|nr|ref|art)\."
#: Where sentences of a message end; between lower-case words the blank may be lacking.
SENTENCE_END = r"[!?。！？…]+|\.+(?=\s|\z|\p{L}{3,}\s)"
#: No heading and no quotation; two words, or four letters of a script that writes no blanks.
NO_HEADING = r'\A[^"“„«»「」]*[^"“„«»「」:：]\z'
TWO_WORDS = r"\p{L}[^ ]* [^ ]*\p{L}|[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]{4}"
#: What stands for an unfilled field.
FIELD_SIGN = "⟦⟧"
#: Languages other than the most frequent one must have so much of a group that recurs widely.
LEAST_SPREAD = 0.1
#: Filler words are looked up as a set up to so many, in a join beyond.
SET_WORDS = 5_000
SEPARATOR = r"(?>\r\n|\r|\n)[ \t\u00a0\u3000]*(?:(?>\r\n|\r|\n)[ \t\u00a0\u3000]*)+"


def paragraphs(documents: DataFrame) -> DataFrame:
    """``doc_id, source, language, masked, key_a, key_b, by, prose`` of each non-empty paragraph of ``documents``.

    Masking: unfilled fields become a sign, e-mail and web addresses '@', numbers with their separators (so
    dates and times too) '0', blanks are collapsed, case is folded. ``by`` says what tells residue by itself
    ('placeholder', 'phrase'), ``prose`` whether wide recurrence would tell it."""
    # masked within the generator, so that no filter or later column masks a paragraph a second time
    whole = F.split("text", SEPARATOR)
    for step in (_without_fields, _without_addresses, _plain):
        whole = F.transform(whole, step)
    whole = F.filter(whole, lambda m: m != "")
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.lower(F.regexp_extract("lang", "^([A-Za-z]{2,3})", 1)).alias("language"), F.explode(whole).alias("masked"))
    sentences = F.split(F.regexp_replace(F.regexp_replace("masked", BULLET, ""), SHORTENED, "$1"), SENTENCE_END)
    phrase = F.col("masked").startswith("lorem ipsum") | (F.col("masked").rlike(BEGINS) & F.forall(sentences, lambda p: (F.trim(p) == "") | F.trim(p).rlike(SENTENCE)))
    by = F.when(F.contains(F.col("masked"), F.lit(FIELD_SIGN)), "placeholder").when(phrase, "phrase")
    return rows.select("*", F.xxhash64("masked").alias("key_a"), F.xxhash64(F.lit("second"), "masked").alias("key_b"), by.alias("by"), (F.col("masked").rlike(NO_HEADING) & F.col("masked").rlike(TWO_WORDS)).alias("prose"))


def _without_fields(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, FIELD_SIGN)


def _without_addresses(text: Column) -> Column:
    some = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))
    return F.when(some, F.regexp_replace(text, r"(?<!\S)[^\s@]+@\S+|(?:https?://|www\.)\S+", "@")).otherwise(text)


def _plain(text: Column) -> Column:
    text = F.regexp_replace(text, r"\p{N}+(?:[.,:/\-–]\p{N}+)*", "0")
    return F.lower(F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r\u00a0\u3000\u202f][\s\u00a0\u3000\u202f]*|\s{2,}", " ")))


KEY = ["key_a", "key_b"]


def widely_recurring(found: DataFrame) -> DataFrame:
    """``key_a, key_b`` of the groups of prose that recur over sources and languages. Notes without a language
    say nothing of languages; counts are combined before each shuffle, so no hot group is gathered."""
    by_language = found.where("prose").groupBy(*KEY, "language").agg(F.count("*").alias("n"), F.min("source").alias("first"), F.max("source").alias("last"))
    named = F.when(F.col("language") != "", F.col("n"))
    whole = by_language.groupBy(*KEY).agg(F.sum(named).alias("n"), F.max(named).alias("most"), F.count(named).alias("languages"), F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.where((F.col("first") != F.col("last")) & (F.col("languages") >= 2) & (F.col("n") - F.col("most") >= LEAST_SPREAD * F.col("n"))).select(*KEY)


def filler_paragraphs(found: DataFrame) -> DataFrame:
    """``key_a, key_b`` of the paragraphs in invented words, each once: nine in ten of their different words (three
    or more) are met beside "lorem ipsum" in a fifth of the paragraphs that hold them.

    Only paragraphs that begin with a word met beside "lorem ipsum" are looked at word by word."""
    words = F.expr(r"array_distinct(filter(regexp_extract_all(masked, '\\p{L}+', 0), w -> length(w) > 1))")
    once = found.select(*KEY, "masked", F.contains(F.col("masked"), F.lit("lorem ipsum")).alias("lorem"), F.regexp_extract("masked", r"\A\P{L}*(\p{L}+)", 1).alias("first"))
    beside = once.where("lorem").select(*KEY, F.explode(words).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("beside"))
    # the vocabulary of filler is small; if it isn't, it is joined instead of listed
    listed = beside.select("word").limit(SET_WORDS + 1).collect()
    if not listed:
        near = once.where(F.lit(False))
    elif len(listed) <= SET_WORDS:
        near = once.where(F.col("first").isin([r["word"] for r in listed]))
    else:
        near = once.join(beside.select(F.col("word").alias("first")), "first", "left_semi")
    met = near.select(*KEY, F.size(words).alias("different"), F.explode(words).alias("word")).distinct()
    shares = met.groupBy("word").agg(F.count("*").alias("all")).join(beside, "word").where("beside >= 0.2 * all").select("word")
    known = met.join(shares, "word").groupBy(*KEY, "different").agg(F.count("*").alias("known"))
    return known.where("different >= 3 and known >= 0.9 * different").select(*KEY)


#: A group may hold a third of all paragraphs: its rows are joined in so many parts.
SALTS = 16


def _verdicts(found: DataFrame) -> DataFrame:
    """``key_a, key_b, verdict`` of the groups that other groups' counts decide, once for each verdict."""
    return widely_recurring(found).withColumn("verdict", F.lit("recurring")).unionByName(filler_paragraphs(found).withColumn("verdict", F.lit("filler")))


def message_paragraphs(found: DataFrame) -> DataFrame:
    """``masked, kind, by, documents, sources, languages`` of the groups that are residue: ``by`` names the rule or
    count that told it. ``found`` comes from :func:`paragraphs`."""
    kind = (
        F.when(F.col("by") == "placeholder", "placeholder").when(F.forall(F.split("masked", SENTENCE_END), lambda p: (F.trim(p) == "") | F.trim(p).rlike(_FILLED)), "filler")
        .when(F.col("verdict") == "filler", "filler").otherwise("message")
    )
    verdicts = _verdicts(found).groupBy(*KEY).agg(F.min("verdict").alias("verdict"))
    groups = (
        found.groupBy(*KEY, "source", "language").agg(F.count("*").alias("n"), F.min("masked").alias("masked"), F.min("by").alias("by"))
        .groupBy(*KEY).agg(F.sum("n").alias("documents"), F.min("masked").alias("masked"), F.min("by").alias("by"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("language") != "", F.col("language"))).alias("languages"))
    )
    told = groups.join(verdicts, KEY, "left").where("by is not null or verdict is not null")
    return told.select("masked", kind.alias("kind"), F.coalesce("by", "verdict").alias("by"), "documents", "sources", "languages")


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each document that carries residue, once.

    Null, empty and blank texts have none. Repeated rows give one; rows whose doc_id is null are left out,
    since they cannot be named. Extra columns are ignored; an empty table gives no rows."""
    rows = spread(documents.select("doc_id", "text", "lang", "source").where("doc_id is not null and text is not null"), "doc_id")
    found = written(documents.sparkSession, paragraphs(rows))  # masked once; counts, words and verdicts read their columns
    by_itself = found.where("by is not null").select("doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    verdicts = _verdicts(found).select(*KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    by_count = found.where("by is null").select("doc_id", *KEY, salt.alias("salt")).join(verdicts, [*KEY, "salt"], "left_semi").select("doc_id")
    return by_itself.unionByName(by_count).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"))


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct message paragraphs with how often and how widely they recur."""
    found = written(spark, paragraphs(spread(table(spark, sf_dir, "documents").where("doc_id is not null and text is not null"), "doc_id")))
    return message_paragraphs(found)


QUERIES = {"p9_found": p9_found, "p9_messages": p9_messages}
ORACLE: dict[str, str] = {}
