"""Person and company names from page texts by labels, suffixes and surnames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import CJK, any_of, blank

# Labels, suffixes in the order in which they are tried, and words that are no names.
COMPANY_LABELS = ("公司名称", "企业名称", "单位名称", "甲方", "乙方", "丙方", "委托方", "受托方", "出卖人", "买受人")
PERSON_LABELS = ("姓名", "负责人", "法定代表人", "联系人", "经办人", "委托人", "代理人", "签字", "签署人")
NAME_TITLES = ("先生", "女士", "经理", "董事", "总经理", "董事长", "主任", "局长", "处长", "总监")
TITLES = ("法定代表人", "总经理", "董事长", "副总经理", "副董事长", "先生", "女士", "经理", "董事", "主任", "局长", "处长", "总监")
SUFFIXES = (
    "股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团有限公司", "律师事务所", "会计师事务所", "事务所", "商业银行", "银行", "信用社",
    "大学", "学院", "医院", "研究院", "研究所", "基金会", "委员会", "控股公司", "投资公司", "科技公司", "技术公司", "集团", "中心", "工厂",
)
CONNECTORS = ("买方为", "卖方为", "甲方为", "乙方为", "丙方为", "买方是", "卖方是", "甲方是", "乙方是", "系", "为", "是", "由", "及", "与", "和", "对", "向", "在", "的", "等", "或")
NO_PERSON = (
    "公司", "有限", "股份", "责任", "集团", "银行", "大学", "学院", "医院", "经理", "董事", "主任", "局长", "处长", "总监", "先生", "女士",
    "申请人", "被申请人", "原告人", "被告人", "当事人", "第三人", "负责人", "联系人", "经办人", "委托人", "代理人", "代表人",
    "法定代表", "本公司", "该公司", "办公室", "委员会", "文字", "日期", "编号", "合同", "协议", "附件", "页码",
)
ENGLISH_FORMS = r"(?:Inc\.?|Ltd\.?|LLC|Corp\.?|Co\.|Company|Corporation)"
COMPANY_LABEL = f"(?:{any_of(COMPANY_LABELS)})[：:\\s]+([^\\n\\r，。；;]{{2,40}})"
PERSON_LABEL = f"(?:{any_of(PERSON_LABELS)})[：:\\s]+([一-鿿·•]{{2,4}})"
PERSON_TITLE = f"([一-鿿]{{2,4}})(?:{any_of(NAME_TITLES)})"
ENGLISH_COMPANY = rf"\b[A-Z][A-Za-z0-9&.\-]*(?:[ \t]+[A-Z][A-Za-z0-9&.\-]*)*(?:[ \t]*,?[ \t]*)?{ENGLISH_FORMS}\b"
ENGLISH_PERSON = r"(?U)\b(?-U)[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)+(?U)\b"
#: Parameters, not fixed: the traditional list, all 408 single and 69 compound surnames.
SURNAMES = frozenset(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜"
    "戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐"
    "费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
    "和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁"
    "杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍"
    "虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚"
    "程嵇邢滑裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓"
    "牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙"
    "叶幸司韶郜黎蓟薄印宿白怀蒲邰从鄂索咸籍赖卓蔺屠蒙池乔阴鬱胥能苍双"
    "闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀郏浦尚农"
    "温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘"
    "匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空"
    "曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
)
COMPOUND_SURNAMES = frozenset((
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 "
    "仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 "
    "段干 百里 呼延 东郭 南门 羊舌 微生 公户 公玉 公仪 梁丘 公仲 公上 公门 公山 公坚 左丘 东门 西门 南荣 即墨 "
).split())


def spaces(text: Column) -> Column:
    return F.regexp_replace(F.btrim(text, F.lit(" \t\n\r　")), r"[ \t　]+", " ")


def english_persons(text: Column) -> Column:
    """Runs of two or more capitalised words of 3 to 40 characters that aren't a company's."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_PERSON), F.lit(0)), spaces)
    return F.filter(found, lambda n: F.length(n).between(3, 40) & ~n.rlike(rf"(?i){ENGLISH_FORMS}\b|university|company"))


def may_name_a_person(text: Column) -> Column:
    """False only where english_persons() finds none: a cheap test before it."""
    return text.rlike(r"[A-Z][a-z]+[ \t]+[A-Z][a-z]")


def labelled(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), spaces)


def english_companies(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_COMPANY), F.lit(0)), lambda n: clean_company(n, True))


def clean_company(raw: Column, needs_form: bool) -> Column:
    """A company's name without its edges, null where it can't be one; Ltd, Inc and Corp get their dot."""
    edge = r" \t　、，,。;；:：\"'“”（）()"
    s = F.regexp_replace(spaces(raw), rf"^[{edge}.]+", "")
    s = F.regexp_replace(s, rf"[{edge}]+$", "")
    s = spaces(F.regexp_replace(s, r"^[的与和及/|\-]+", ""))
    chinese, english = s.rlike(f"(?:{any_of(SUFFIXES)})$"), s.rlike(rf"(?i){ENGLISH_FORMS}\b")
    n_cjk = F.length(F.regexp_replace(s, f"[^{CJK}]", ""))
    good = F.length(s).between(2, 60) & (chinese | english | (F.lit(not needs_form) & (n_cjk >= 2) & (F.length(s) >= 4)))
    return F.when(good, F.when(s.rlike(r"(?i)(?:Ltd|Inc|Corp)$"), F.concat(s, F.lit("."))).otherwise(s))


def label_names(pages: DataFrame) -> DataFrame:
    """(doc_id, page, kind, name) per event of a label, a title or an English form. Catalyst only."""
    text = F.col("text")
    event = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    company = event("company", F.filter(F.concat(F.transform(labelled(text, COMPANY_LABEL), lambda n: clean_company(n, False)), english_companies(text)), lambda n: n.isNotNull()))
    person = event("person", english_persons(text))
    return pages.filter(~blank(text)).select("doc_id", "page", F.explode(F.concat(company, person)).alias("e")).select("doc_id", "page", "e.kind", "e.name")


_SPACES = re.compile(r"[ \t　]+")
_ENGLISH = re.compile(rf"{ENGLISH_FORMS}\b", re.I)
_SUFFIX = f"(?:{any_of(SUFFIXES)})"
_RUN = re.compile(rf"[{CJK}A-Za-z0-9·•&\-]*\Z")
_HEADS = re.compile(f"^(?:{any_of(CONNECTORS)})*(.)")
_PERSON = re.compile(f"[{CJK}·]{{2,4}}(?<!{')(?<!'.join(TITLES)})")
_NOT_IN_PERSON = re.compile(any_of((*NO_PERSON, *SUFFIXES)))
BACK = 40  # characters before a suffix that may belong to its name
CLEAR = 12  # characters after a person's name in which no company's suffix begins


class Heuristics:
    """Events of names in a text by suffix and surname; a name counts once for each rule and suffix that finds it."""

    def __init__(self, surnames=SURNAMES, compounds=COMPOUND_SURNAMES):
        self.person_rules = [re.compile(PERSON_LABEL), re.compile(PERSON_TITLE)]
        single, compound = f"[{''.join(sorted(surnames))}]", f"(?:{any_of(tuple(sorted(compounds)))})"
        self.has_surname = re.compile(f"{compound}(?=.)|{single}", re.S)
        # where a run of characters begins: each way to read a name there, longest surname and then longest given name first
        given, ends = f"(?:(?!{_SUFFIX})[{CJK}·•])", f"(?=[^{CJK}·•]|\\Z|{any_of(TITLES)})(?![\\s\\S]{{0,{CLEAR}}}{_SUFFIX})"
        ways = "".join(f"(?=({surname}{given}{{{n}}}{ends})?)" for surname in (compound, single) for n in (2, 1))
        self.begins = re.compile(f"(?<![{CJK}])(?=[{CJK}]){ways}")

    def company(self, raw: str) -> str | None:
        s = _SPACES.sub(" ", raw.strip()).lstrip(" \t　、，,。;；:：\"'“”（）().").rstrip(" \t　、，,。;；:：\"'“”（）()")
        s = _SPACES.sub(" ", re.sub(r"^[的与和及/|\-]+", "", s).strip())
        if not 2 <= len(s) <= 60 or not (s.endswith(SUFFIXES) or _ENGLISH.search(s)):
            return None
        return s + "." if re.search(r"(?:Ltd|Inc|Corp)\Z", s, re.I) else s

    def by_suffix(self, text: str):
        """A company before each occurrence of each suffix: name characters up to 40 back, without leading connectors."""
        for suffix in SUFFIXES:
            for m in re.finditer(suffix, text):
                before = _RUN.search(text, max(0, m.start() - BACK), m.start())[0]
                if len(before) == min(BACK, m.start()):  # nothing but the name lies there
                    before = _HEADS.sub(r"\1", before)
                name = self.company(before + suffix) if len(before + suffix) >= 4 else None
                if name:
                    yield name

    def person(self, raw: str) -> str | None:
        s = _SPACES.sub(" ", raw.strip()).strip(" \t　、，,。.").replace("•", "·")
        fits = _PERSON.fullmatch(s) and not _NOT_IN_PERSON.search(s) and self.has_surname.match(s)
        return s if fits else None

    def by_surname(self, text: str):
        """Surnames at the start of a run with two characters more or one, before its end or a title and far from a suffix."""
        free = 0
        for m in self.begins.finditer(text):
            if m.start() >= free and (name := next(filter(None, map(self.person, filter(None, m.groups()))), None)):
                yield name
                free = m.start() + len(name)

    def events(self, text: str):
        for name in self.by_suffix(text):
            yield "company", name
        for rule in self.person_rules:
            for m in rule.finditer(text):
                if name := self.person(m[1]):
                    yield "person", name
        for name in self.by_surname(text):
            yield "person", name


def heuristic_names(pages: DataFrame, surnames=SURNAMES, compounds=COMPOUND_SURNAMES) -> DataFrame:
    """(doc_id, page, kind, name) per event of a suffix or a surname, over Arrow batches."""
    kinds = dict(pages.dtypes)

    def run(batches):
        import pyarrow as pa

        rules = Heuristics(surnames, compounds)
        for b in batches:
            at, kind, name = [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                for x, n in rules.events(text):
                    at.append(k)
                    kind.append(x)
                    name.append(n)
            i = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(kind, pa.string()), pa.array(name, pa.string())], names=["doc_id", "page", "kind", "name"])

    some = pages.filter(~blank(F.col("text"))).select("doc_id", "page", "text")
    return some.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, kind string, name string")
