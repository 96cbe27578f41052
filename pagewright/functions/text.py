"""Column functions over page texts and names. All run inside Catalyst plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Character classes and word lists of the name rules.
CJK = "一-鿿㐀-䶿"
GLUE = CJK + r"\p{Nd}()\[\]【】「」·"
EDGE = r" ，,。；;：:、\"'“”‘’《》<>【】\[\]"  # and the dot, which has a rule of its own
ABBREVIATIONS = ("Corporation", "Company", "Corp", "LLC", "Ltd", "Inc", "Co")
PERSON_TITLES = (
    "委托诉讼代理人", "诉讼代理人", "委托代理人", "副总经理", "副董事长", "总经理", "董事长", "副总裁", "人民陪审员", "审判长", "审判员", "书记员",
    "女士", "先生", "同志", "经理", "董事", "主任", "局长", "处长", "科长", "总监", "总裁",
)
ORG_SUFFIXES = ("合伙企业", "合作社", "事务所", "信用社", "公司", "集团", "银行", "厂")
INSTITUTIONS = ("大学", "学院", "医院", "学校", "中学", "小学", "研究院", "研究所")
GOVERNMENT = ("人民法院", "人民检察院", "派出所", "公安局", "公安厅", "人民政府", "司法局", "监督管理局", "仲裁委员会", "监察委员会", "管委会", "管理委员会", "街道办事处")
GENERIC_COMPANIES = ("公司", "有限公司", "股份有限公司", "有限责任公司", "集团", "集团公司", "银行", "分公司", "本公司", "该公司", "我公司", "贵公司")
ROLE_WORDS = (
    "原告", "被告", "第三人", "甲方", "乙方", "丙方", "丁方", "买方", "卖方", "出卖人", "买受人", "法定代表人", "委托人", "受托人", "代理人",
    "委托代理人", "诉讼代理人", "委托诉讼代理人", "审判长", "审判员", "人民陪审员", "书记员", "申请人", "被申请人", "申请执行人", "被执行人",
    "本公司", "该公司", "本人", "我方", "对方", "贵方", "先生", "女士", "同志", "经理", "总经理", "董事长", "联系人", "经办人", "负责人", "当事人",
)
BRANCHES = ("分公司", "支公司", "分行", "支行", "营业部", "办事处")
LEGAL_FORMS = ("股份有限公司", "有限责任公司", "有限公司", "股份公司")
LOOKALIKES = ("司同", "司可", "术木", "份分", "技枝", "己已", "己巳", "已巳", "日曰", "未末", "人入", "土士", "干千", "微徵", "拨拔", "戊戌", "戊戍", "戌戍", "银很", "行形", "有右", "厂广", "大太")

_SPACE = r"[ \t\n\r\f\x0B]+"
_ABBREVIATION = f"(?:^|[ ,.])(?:{'|'.join(ABBREVIATIONS)})"
HEAD_CHARS = 240


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def blank(text: Column) -> Column:
    """Null, or nothing but Unicode white space."""
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def line_breaks(text: Column) -> Column:
    """CRLF, CR and FF as LF; Unicode white space trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?|\f", "\n"), r"(?U)^\s+|\s+$", "")


def nonspace_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")).cast("long")


def fold(text: Column) -> Column:
    """Full-width ASCII to ASCII, the ideographic space to a blank, bullets to the middle dot."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, wide + "　•・", "".join(chr(ord(c) - 0xFEE0) for c in wide) + " ··")


def ends_with_abbreviation(text: Column) -> Column:
    return text.rlike(f"(?i){_ABBREVIATION}$")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{EDGE}.]+", ""), rf"(?i)(?:(?<!{_ABBREVIATION})\.|[{EDGE}])+$", "")


def joined_space(text: Column) -> Column:
    """Folded text whose white space is gone between glued characters of which one is CJK, and one blank elsewhere."""
    drop = f"(?<=[{CJK}]){_SPACE}(?=[{GLUE}])|(?<=[{GLUE}]){_SPACE}(?=[{CJK}])"
    return F.regexp_replace(F.regexp_replace(fold(text), drop, ""), _SPACE, " ")


def repair(text: Column) -> Column:
    """A name as it should read: spaces joined, edges trimmed, one pair of enclosing brackets removed. Null gives ''."""
    t = _trimmed(joined_space(F.coalesce(text, F.lit(""))))
    return _trimmed(F.regexp_replace(t, r"^\((.*)\)$", "$1"))  # trimming twice changes nothing elsewhere


def repair_person(text: Column) -> Column:
    """repair() without one title at the end and one at the start, where more than one character stays."""
    t = repair(text)
    tail = F.trim(F.regexp_replace(t, f"^(.{{2,}}?)(?:{any_of(PERSON_TITLES)})$", "$1"))
    longest = sorted(PERSON_TITLES, key=len, reverse=True)
    return F.trim(F.regexp_replace(tail, f"^(?:{any_of(tuple(longest))})(.{{2,}})$", "$1"))


def identity(text: Column) -> Column:
    """repair() without the dot of a final abbreviation: equal names compare equal by it."""
    return F.regexp_replace(repair(text), rf"(?i)(?<={_ABBREVIATION})\.$", "")


def acceptable_company(name: Column) -> Column:
    n, plain = F.length(name), ~name.contains("公司")
    wrong = name.isin(*GENERIC_COMPANIES) | (plain & name.rlike(any_of(GOVERNMENT))) | (plain & name.rlike(f"(?:{any_of(INSTITUTIONS)})$"))
    return n.between(4, 80) & ~wrong & (name.rlike(f"(?:{any_of(ORG_SUFFIXES)})$") | ends_with_abbreviation(F.regexp_replace(name, r"\.$", "")))


def acceptable_person(name: Column) -> Column:
    n_cjk = F.length(F.regexp_replace(name, f"[^{CJK}]", ""))
    n_letters = F.length(F.regexp_replace(name, rf"[^\p{{L}}]|[{CJK}]", ""))
    most = F.when(name.contains("·"), 16).otherwise(6)
    shape = (n_letters > 0) | ((n_cjk >= 2) & (n_cjk <= most))
    return F.length(name).between(2, 40) & ~name.contains("某") & ~name.isin(*ROLE_WORDS) & ~acceptable_company(name) & shape


def confusable(surface: Column, corrected: Column) -> Column:
    """Same length of 6 or more, and exactly one place differs, by a known lookalike pair."""
    pairs = sorted({p for a, b in LOOKALIKES for p in (a + b, b + a)})
    apart = F.filter(F.zip_with(F.split(surface, ""), F.split(corrected, ""), lambda a, b: F.when(a != b, F.concat(a, b))), lambda x: x.isNotNull())
    return (F.length(surface) == F.length(corrected)) & (F.length(surface) >= 6) & (F.size(apart) == 1) & F.element_at(apart, 1).isin(pairs)


def is_branch(longer: Column, shorter: Column) -> Column:
    rest = longer.substr(F.length(shorter) + 1, F.length(longer))
    return longer.startswith(shorter) & rest.rlike(any_of(BRANCHES))


def page_block(page: Column, text: Column) -> Column:
    """A page as it stands in a prompt."""
    return F.concat(F.lit("--- page "), page.cast("string"), F.lit(" ---\n"), text, F.lit("\n"))


def with_lookahead(prompt: Column, head: Column) -> Column:
    """prompt with the beginning of what follows, where there is any."""
    return F.when(head.isNull(), prompt).otherwise(F.concat(prompt, F.lit("--- next ---\n"), head, F.lit("\n")))


def clip_middle(text: Column, most: int = 64_000, mark: str = "\n...\n") -> Column:
    """A long text's first and last halves around a mark."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def redact(text: Column, keys: list[str]) -> Column:
    """Each key, longest first, as ***."""
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit("***")), sorted((k for k in keys if k), key=lambda k: (-len(k), k)), text)


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)


def json_object(raw: Column) -> Column:
    """From the first { to the last }, null without; a fence around it falls away."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def strict_json(raw: Column) -> Column:
    """Comments and trailing commas outside strings removed, so that from_json() takes it."""
    strings = r'"(?:[^"\\]|\\.)*"'
    plain = F.regexp_replace(raw, rf"(?s)({strings})|/\*.*?\*/|//[^\n]*", "$1")
    return F.regexp_replace(plain, rf"({strings})|,(?=\s*[\]}}])", "$1")
