"""Fixed values that comparisons depend on: word lists, patterns and labels, in their natural order."""

# Core keywords of the domain, as alternatives of one pattern; the first that matches wins.
KEYWORDS = (
    r"u[- ]?plane", r"user[- ]?plane", r"up[- ]?field", r"iq\s*data", r"user\s*plane",
    r"c[- ]?plane", r"control[- ]?plane", r"cp[- ]?field", r"control\s*plane",
    r"channel", r"transport", r"mapping", r"beam", r"antenna",
    r"message", r"ie\s*field", r"information\s*element", r"header", r"payload",
    r"timing", r"sync", r"synchronization", r"clock",
    r"framing", r"sequence", r"compression", r"crypt",
)

TOC_LINE = r"^[\d.]+\s+.+\.{3,}\s*\d+$"

# (pattern, group of the title, depth), first hit wins; depth 0: the first group is the level in compat mode.
HEADINGS = (
    (r"^(\d+)\.\s+(.+)$", 2, 1),
    (r"^(\d+)\.(\d+)\s+(.+)$", 3, 2),
    (r"^(\d+)\.(\d+)\.(\d+)\s+(.+)$", 4, 3),
    (r"^(\d+)\.(\d+)\.(\d+)\.(\d+)\s+(.+)$", 5, 4),
    (r"^(?i:(Annex|Appendix)\s+([A-Z])\.\s+(.+))$", 3, 1),
    (r"^([A-Z])\.\s+(.+)$", 2, 1),
    (r"^(\d+)[-](\d+)\s+(.+)$", 3, 2),
    (r"^(\d+)[-](\d+)[-](\d+)\s+(.+)$", 4, 3),
)

RUNNING_HEADS = (r"^3GPP\s+TS\s+\d+\.\d+", r"^(?i:\d+\s+Release\s+\d+)", r"^Version\s+\d+-\d+-\d+", r"^(?i:Page\s+\d+\s+of\s+\d+)")
RUNNING_HEADS_WORD = (r"^(?i:3GPP\s+TS\s+\d+\.\d+)", r"^(?i:Page\s+\d+\s+of\s+\d+)", r"^(?i:\d+\s+Release\s+\d+)")

NUMBERED_TITLES = ((r"^(\d+(?:\.\d+)*)\s+(.+)$", 2), (r"^([A-Z])\.\s+(.+)$", 2), (r"^(?i:(Annex|Appendix)\s+([A-Z])\.?\s+(.+))$", 3))

STYLES = {"heading 1": 1, "heading1": 1, "heading 2": 2, "heading2": 2, "heading 3": 3, "heading3": 3, "heading 4": 4, "heading4": 4, "title": 1, "caption": 0}

TITLE_BLACKLIST = (
    "contents", "table of contents", "目录", "list of tables", "表格列表", "list of figures", "图列表",
    "references", "参考文献", "index", "索引", "revision history", "修订历史", "document history",
    "document version history", "版本历史", "版本说明", "release notes", "release history", "foreword", "前言",
    "glossary", "术语", "abbreviations", "缩写", "notice", "notice of", "copyright", "版权",
    "intel confidential", "astri confidential", "confidential and proprietary",
)

CONTENT_SIGNALS = (
    "©", "all rights reserved", "re-published", "confidential", "adopter license", "o-ran alliance",
    "re-published version", "astri confidential", "document number:", "version number:", "product reference:",
    "registered in hong kong", "buschkauler weg", "intel corporation", "astri inc 2018", "intel confidential",
    "confidential and proprietary", "ip rights policy", "adopter license agreement", "o-ran adopter license",
    "annex zzz", "final specification", "re-published version of the attached final specification",
    "prior versions of the ipr policy will apply", "nr cran rru design",
    "applied science and technology research institute", "astri company limited", "1st draft", "2nd draft",
    "respond to comments from", "all data is preliminary and subject to",
)

TOC_PATTERNS = (r"(?m)\.{3,}\s*\d+$", r"(?m)^\s*[\d.]+\s+.+\.{4,}")

# Hints of the knowledge base: (name, keywords, priority); ties keep this order.
HINTS = (
    ("前传切分", ("Split8", "Split7.2x", "7-2x", "PHY Low", "PHY High"), 10),
    ("C-plane Section Type", ("section type", "sectionType", "Section Type 0", "Section Type 1", "Section Type 3", "Section Type 5", "Section Type 6"), 10),
    ("eCPRI Header", ("eCPRI", "MessageType", "PC_RTC", "eCPRI header", "ecpri_msg"), 10),
    ("PRACH", ("PRACH", "preamble", "random access", "RACH", "timeOffset"), 10),
    ("时钟同步", ("PTP", "G.8275", "SyncE", "synchronization", "S-plane", "clock", "timestamp", "timing advance"), 10),
    ("压缩算法", ("compression", "BFP", "μ-law"), 9),
    ("LLS拓扑配置", ("LLS-C1", "LLS-C2", "LLS-C3", "LLS-C4"), 9),
    ("FFT Size", ("FFT", "FFT size", "IFFT", "FFT点数"), 8),
    ("Sub-carrier Spacing", ("sub-carrier spacing", "SCS", "subcarrier", "kHz", "numerology"), 8),
    ("Beamforming", ("beamforming", "beam index", "BF weight", "precoding", "预编码", "beam"), 7),
    ("AxC 映射", ("AxC", "antenna-carrier", "eAxC", "AxC container", "AxC_ID"), 7),
    ("U-plane IQ Format", ("IQ format", "I/Q", "IQ sample", "data section", "UDcomp", "udCompHdr"), 7),
    ("Compression Algorithm", ("compression", "BFP", "block floating point", "μ-law", "mu-law", "modulation compression", "beamspace compression"), 6),
    ("Fragmentation", ("fragmentation", "fragment", "分段", "MTU"), 6),
    ("QoS", ("QoS", "Quality of Service", "prioritization", "VLAN", "DSCP"), 5),
    ("Channel Bandwidth", ("bandwidth", "channel bandwidth", "MHz", "频宽"), 5),
    ("RU Category", ("CAT-A", "CAT-B", "RU category", "Category A", "Category B"), 4),
    ("Component Carrier", ("CC", "Component Carrier", "载波", "carrier"), 3),
    ("Test Specification", ("test", "conformance", "验证", "测试", "testing"), 2),
    ("M-plane Management", ("M-plane", "management", "NETCONF", "配置", "监控", "告警"), 2),
    ("Energy Saving", ("energy saving", "transmission blanking", "节能", "power saving"), 1),
)

# Dimensions: the first group with a keyword in the text names itself by its last keyword.
DIMENSIONS = (
    ("eCPRI", "前传", "fronthaul", "切分", "split"),
    ("Section Type", "C-plane", "control plane"),
    ("同步", "PTP", "1588", "SyncE", "时钟", "timing", "clock"),
    ("压缩", "compression", "IQ", "quantization"),
    ("FFT", "子载波", "scs", "Sub-carrier"),
    ("波束", "beamforming", "Beam", "AxC", "eAxC"),
    ("RU", "Radio Unit", "天线单元"),
    ("QoS", "带宽", "bandwidth"),
    ("M-plane", "管理", "management"),
    ("UE", "user equipment", "终端"),
    ("测试", "test specification"),
    ("节能", "energy saving", "省电"),
)
NO_DIMENSION = "其他"

TYPE_LABELS = {
    "feature_added": "功能新增 (feature_added)", "feature_changed": "功能变更 (feature_changed)",
    "feature_removed": "功能删除 (feature_removed)", "unknow_diff": "未知差异 (unknow_diff)",
    "design_diff": "设计差异 (design_diff)", "param_diff": "参数差异 (param_diff)",
    "consistency_issue": "一致性问题 (consistency_issue)", "new_feature": "新功能章节 (new_feature)",
    "new_design": "新设计章节 (new_design)", "new_parameter": "新参数章节 (new_parameter)",
    "scope_diff": "范围差异 (scope_diff)", "other": "其他 (other)",
}
IMPACTS = ("高", "中", "低")
NO_QUOTE = "(无原文引用)"
CUT_NOTICE = "\n...(truncated)"

# Words left out of TF-IDF terms: a short list of our own; scikit-learn's is a parameter away.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")

# What the rules say of a row, by the sides it has; users read it.
FALLBACK_DESCRIPTIONS = {
    "base_only": "Base 版本中此章节在 Compare 版本中不存在（LLM 不可用: {reason}）",
    "compare_only": "Compare 版本中此章节在 Base 版本中不存在（LLM 不可用: {reason}）",
    "pair": "对齐章节 LLM 分析失败（{reason}），差异类型未知，需重新运行以确认",
}
FALLBACK_HINTS = {"base_only": "需确认该功能是否仍在 Compare 中实现", "compare_only": "需确认该功能是否为 Compare 新增", "pair": "需重新运行以获得准确差异分类"}
FALLBACK_SUMMARIES = {"base_only": "Base 独有章节（LLM 兜底）", "compare_only": "Compare 独有章节（LLM 兜底）", "pair": "对齐章节 LLM 调用失败（{reason}），差异类型未知（unknow_diff）"}
