"""Rule packs: all that a detector looks for is data. Patterns are in RE2 syntax."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Pack:
    """Patterns by name, keyword sets by name, their weights, and the marker vocabulary."""

    name: str
    patterns: dict[str, str]
    keywords: dict[str, tuple[str, ...]]
    keyword_weights: dict[str, float]
    strict_marker: str
    loose_marker: str
    levels: tuple[tuple[str, int], ...]  # marker word, interchange level
    byte_words: tuple[tuple[str, str, int, str], ...] = ()  # label, word, level, hexadecimal bytes; first hit wins
    copy_words: tuple[str, ...] = ("份号", "编号")
    needs: dict[str, str] = field(default_factory=dict)  # by pattern, a string that every match holds


#: Levels of the interchange record.
TOP_SECRET, SECRET, CONFIDENTIAL, INTERNAL = 1, 2, 3, 4

# Patterns of official documents.
_TYPES = "通知|决定|意见|报告|请示|批复|函|公告|通报|命令|议案|纪要|办法|规定|条例|细则|方案|计划|总结|规划"
OFFICIAL_PATTERNS = {
    "doc_number": r"[〔\[\(（]\s*(19|20)\d{2}\s*[〕\]\)）]\s*\d{1,4}\s*号",
    "doc_number_full": r"[\p{Han}]{1,10}[发办函令〔\[\(（].*?[〔\[\(（]\s*(19|20)\d{2}\s*[〕\]\)）]\s*\d{1,4}\s*号",
    "title": rf"关于.{{2,100}}的({_TYPES})",
    "title_type": rf"({_TYPES})$",
    "secret_level": r"(绝密|机密|秘密)[★☆*]?\s*(\d{1,3}年)?",
    "urgency": r"(特急|加急|平急|特提|限时)",
    "issuer": r"签\s*发\s*人\s*[:：]?\s*[\p{Han}]{2,4}",
    "multi_issuer": r"签\s*发\s*人\s*[:：]?\s*([\p{Han}]{2,4}\s*)+",
    "main_send": r"(各省|各市|各县|各区|各部门|各单位|各有关)[\p{Han}、,，\s]*[:：]?",
    "issue_date": r"(19|20)\d{2}\s*年\s*(0?[1-9]|1[0-2])\s*月\s*(0?[1-9]|[12]\d|3[01])\s*日",
    "issue_date_numeric": r"(19|20)\d{2}[-/.年](0?[1-9]|1[0-2])[-/.月](0?[1-9]|[12]\d|3[01])日?",
    "copy_to": r"抄\s*送\s*[:：]\s*.{2,200}[。.]?",
    "print_info": r"[\p{Han}]{2,30}\s*(19|20)\d{2}年\d{1,2}月\d{1,2}日\s*(印发|印制|发布)",
    "attachment": r"附\s*件\s*[:：]?\s*(\d+\s*[.、]\s*)?.{2,100}",
    "contact": r"联\s*系\s*人\s*[:：]\s*[\p{Han}]{2,4}",
    "phone": r"(联系电话|电\s*话|联系方式)\s*[:：]?\s*[\d\-\(\)\s]{7,20}",
    "signature": r"[\p{Han}]{4,30}\s*[\(（]?\s*(盖\s*章|印)?\s*[\)）]?",
}

# Keywords of official documents by set.
OFFICIAL_KEYWORDS = {
    "org": (
        "中共中央", "国务院", "全国人大", "全国政协", "中央办公厅", "国务院办公厅", "中央委员会", "中央纪委", "中央组织部", "中央宣传部", "外交部", "国防部", "发展改革委", "教育部",
        "科技部", "工业和信息化部", "国家民委", "公安部", "国家安全部", "民政部", "司法部", "财政部", "人力资源社会保障部", "自然资源部", "生态环境部", "住房城乡建设部", "交通运输部",
        "水利部", "农业农村部", "商务部", "文化和旅游部", "国家卫生健康委", "退役军人事务部", "应急管理部", "中国人民银行", "审计署", "省人民政府", "省政府", "市人民政府", "市政府",
        "县人民政府", "县政府", "区人民政府", "区政府", "自治区人民政府", "直辖市人民政府", "省委", "市委", "县委", "区委", "省人大", "市人大", "县人大", "省政协", "市政协", "县政协",
        "办公室", "办公厅", "委员会", "管理局", "管理处", "工作委员会", "领导小组", "指挥部",
    ),
    "doctype": (
        "决议", "决定", "命令", "公报", "公告", "通告", "意见", "通知", "通报", "报告", "请示", "批复", "议案", "函", "纪要", "办法", "规定", "条例", "细则", "规则",
        "方案", "计划", "总结", "规划", "要点", "简报", "会议纪要", "工作要点", "实施意见", "实施方案", "实施办法", "实施细则", "管理办法", "管理规定", "暂行办法", "暂行规定",
        "工作方案", "工作计划", "工作总结", "工作报告",
    ),
    "action": (
        "印发", "发布", "公布", "颁布", "下发", "转发", "批转", "颁发", "请示", "报请", "呈报", "申请", "请求", "恳请", "报批", "请批", "批复", "批准", "同意", "核准",
        "批示", "通知", "告知", "函告", "函复", "知照", "执行", "遵照", "贯彻", "落实", "实施", "遵循", "按照", "依照", "根据",
    ),
    "header": (
        "发文字号", "签发人", "密级", "紧急程度", "特急", "加急", "平急", "限时", "绝密", "机密", "秘密", "文件", "文号",
    ),
    "footer": (
        "抄送", "主送", "印发", "印制", "主题词", "抄报", "发送", "存档", "归档", "联系人", "联系电话", "联系方式", "共印", "份",
    ),
    "formal": (
        "为了", "为进一步", "根据", "按照", "依据", "遵照", "鉴于", "为贯彻", "为落实", "现就", "现将", "特此", "兹", "为此", "经研究", "经审核", "经批准", "特此通知",
        "特此通告", "特此公告", "请遵照执行", "请认真贯彻执行", "请结合实际", "望遵照执行", "请予以支持", "请予以配合", "此复", "此函", "特此函复", "专此函达", "以上报告", "妥否",
        "请批示", "请审批", "敬请", "恳请", "请予", "盼复", "函复",
    ),
    "prohibited": (
        "价格", "报价", "合同", "订单", "发票", "采购", "销售", "客户", "供应商", "折扣", "优惠", "促销", "摘要", "关键词", "参考文献", "引言", "abstract",
        "keywords", "references", "致谢", "论文", "学位", "记者", "编辑", "来源", "转载", "本报讯", "据悉", "消息", "立即购买", "点击", "咨询热线", "免费", "限时",
        "抢购",
    ),
}
#: Weights of keyword sets in the keyword score.
KEYWORD_WEIGHTS = {"org": 0.15, "doctype": 0.20, "action": 0.10, "header": 0.15, "footer": 0.10, "formal": 0.08, "prohibited": -0.20}

WORDS = (("绝密", TOP_SECRET), ("机密", SECRET), ("秘密", CONFIDENTIAL))


def _byte_words(compat: bool) -> tuple[tuple[str, str, int, str], ...]:
    """Byte forms by encoding: RTF escapes of GBK, UTF-8, GBK, UTF-16LE."""
    gbk = {w: w.encode("gbk") for w, _ in WORDS}
    utf16 = {w: w.encode("utf-16-le") for w, _ in WORDS}
    if compat:  # fixed values: three byte forms that the compatible scanner spells otherwise, and never finds in real text
        gbk["秘密"] = bytes.fromhex("C3DCC3DC")
        utf16["绝密"] = bytes.fromhex("5D7EC65B")
        utf16["秘密"] = bytes.fromhex("C65BC65B")
    rtf = {w: "".join(f"\\'{b:02x}" for b in gbk[w]).encode() for w, _ in WORDS}
    forms = (("RTF", rtf), ("UTF8", {w: w.encode() for w, _ in WORDS}), ("GBK", gbk), ("UTF16", utf16))
    return tuple((f"{w}({kind})", w, level, form[w].hex().upper()) for kind, form in forms for w, level in WORDS)


OFFICIAL = Pack(
    "official", OFFICIAL_PATTERNS, OFFICIAL_KEYWORDS, KEYWORD_WEIGHTS,
    r"(绝密|机密|秘密)\s*[★\*]\s*(\d{1,2}年|长期)?", r"(绝密|机密|秘密)", WORDS, _byte_words(False),
    needs={
        "doc_number": "号", "doc_number_full": "号", "title": "关于", "secret_level": "密", "issuer": "人", "multi_issuer": "人", "main_send": "各",
        "issue_date": "日", "copy_to": "送", "print_info": "日", "attachment": "件", "contact": "人",
    },
)
OFFICIAL_COMPAT = replace(OFFICIAL, name="official_compat", byte_words=_byte_words(True))

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_IPV4 = r"(\d{1,3}\.){3}\d{1,3}"
#: The same roles in Latin script, for corpora without Han characters.
LATIN = Pack(
    "latin",
    {
        "doc_number": r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}",
        "doc_number_full": r"[A-Za-z]{3,20}: \d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}",
        "title": r"[A-Z][a-z]{2,12} (of|de|la|der|the|les) [a-z]{3,12}",
        "title_type": r"(tion|ing|ment|ung|ado)$",
        "secret_level": r"(token|secret|password|api_key)\s*[=:]\s*[A-Za-z0-9_\-]{4,}",
        "urgency": r"(!!)",
        "issuer": r"(by|par|von|por): ?[A-Za-z]{2,20}",
        "multi_issuer": r"(by|par|von|por): ?([A-Za-z]{2,20} ?)+",
        "main_send": r"(To|Les|Die|Los) [a-z]{2,20},",
        "issue_date": r"(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])",
        "issue_date_numeric": r"(19|20)\d{2}[/.](0?[1-9]|1[0-2])[/.](0?[1-9]|[12]\d|3[01])",
        "copy_to": _EMAIL,
        "print_info": _IPV4,
        "attachment": r"[Ll]icen[sc]e[^.\n]{2,60}",
        "contact": r"\+?\d{1,3}[ -]\d{3}[ -]\d{3,4}[ -]\d{4}",
        "phone": r"\(?\d{3}\)?[ -]\d{3}[ -]\d{4}",
        "signature": r"[A-Z][a-z]{3,12} [A-Z][a-z]{3,12}",
    },
    {
        "org": ("with", "from", "avec", "dans", "nicht", "eine", "para", "como"),
        "doctype": ("tion", "ment", "ung", "ado"),
        "action": ("ing", "aux", "lich", "mente"),
        "header": ("the ", "les ", "die ", "los "),
        "footer": ("license", "licence", "copyright", "all rights"),
        "formal": ("which", "pour", "sich", "sobre", "that"),
        "prohibited": ("$$$", "!!", " | ", "%%%"),
    },
    KEYWORD_WEIGHTS,
    r"(token|secret|password|api_key)\s*[=:]\s*[A-Za-z0-9_\-]{4,}", r"(token|secret|password|api_key)",
    (("token", TOP_SECRET), ("secret", SECRET), ("password", SECRET), ("api_key", CONFIDENTIAL)),
    tuple((f"{w}(UTF8)", w, level, w.encode().hex().upper()) for w, level in (("password", SECRET), ("secret", SECRET), ("license", INTERNAL), ("@", INTERNAL))),
    copy_words=("copy no", "number"),
    needs={"doc_number_full": ": ", "issuer": ":", "multi_issuer": ":", "main_send": ",", "copy_to": "@", "print_info": ".", "attachment": "icen", "urgency": "!!"},
)

PATTERN_ORDER = tuple(OFFICIAL_PATTERNS)
KEYWORD_ORDER = tuple(KEYWORD_WEIGHTS)
