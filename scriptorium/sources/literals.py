"""Literal tables: default terms, readings for speech, rewritings of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from scriptorium.functions import text as T
from scriptorium.operators import glossary as G

# Term, translation, mode, note, aliases.
DEFAULT_TERMS = [
    ("retrieval stopping", "检索停止", G.HINT, "主动停止记忆提取", []),
    ("thought suppression", "思维压抑", G.HINT, "与 retrieval stopping 区分", []),
    ("transdiagnostic", "跨诊断", G.HINT, "跨越多种疾病类别存在", []),
    ("intrusive thinking", "侵入性思维", G.HARD, "", ["闯入性思维", "侵扰性思维"]),
    ("mnemonic capture", "记忆捕获", G.HINT, "皮层重激活后劫持海马控制", []),
    ("inhibitory control", "抑制控制", G.HARD, "", ["抑制性控制"]),
    ("hippocampal disinhibition", "海马去抑制", G.HARD, "", ["海马抑制解除"]),
    ("GABAergic inhibition", "GABA 能抑制", G.HARD, "", []),
    ("irritable bowel syndrome", "肠易激综合征", G.HARD, "", ["过敏性肠综合征"]),
    ("IBS", "肠易激综合征", G.HARD, "", []),
    ("gut-brain axis", "脑-肠轴", G.HARD, "", ["肠脑轴"]),
    ("visceral hypersensitivity", "内脏高敏感性", G.HARD, "", []),
    ("type 2 diabetes", "2型糖尿病", G.HARD, "", []),
    ("insulin resistance", "胰岛素抵抗", G.HARD, "", []),
    ("MASH", "代谢功能障碍相关脂肪性肝炎", G.HARD, "", []),
    ("fibrosis", "纤维化", G.HARD, "", []),
    ("reassurance", "消除疑虑与病情安抚", G.HARD, "", ["消除疑虑", "心理安抚", "安慰", "安抚"]),
    ("multi-omics", "多组学", G.HARD, "", []),
]
# A word and how the speech engine should read it.
POLYPHONE_RULES = [
    ("黏膜", "粘膜"), ("血栓栓塞", "血栓栓色"), ("梗塞", "梗色"), ("脑梗塞", "脑梗色"), ("校正", "矫正"), ("散在", "伞在"), ("创伤", "chuang1 伤"),
    ("行剖宫产", "进行剖宫产"), ("行结扎术", "进行结扎术"), ("重性抑郁", "仲性抑郁"), ("中型棘状", "中型及状"),
]
# Patterns of titles in their order, case-insensitive, and what stands for them.
TITLE_RULES = [
    ("irritable bowel syndrome: disease mechanisms and clinical management", "肠易激综合征：疾病机制与临床管理"),
    ("mechanisms of intrusive thinking and retrieval stopping in mental health", "精神健康中侵入性思维与检索停止的神经机制"),
    ("targeting tertiary lymphoid structures in cancer immunotherapy", "肿瘤免疫治疗中三级淋巴结构（TLS）的靶向调控"),
    ("next-generation antibody-drug conjugates: engineering innovations and clinical paradigms", "下一代抗体偶联药物（ADC）：工程创新与临床范式"),
    (r"metabolic dysfunction-associated steatohepatitis \(mash\): mechanisms and emerging therapies", "代谢相关脂肪性肝炎（MASH）：发病机制与新兴疗法"),
    ("pathophysiology of type 2 diabetes: a comprehensive endocrine perspective", "2型糖尿病的病理生理学：综合内分泌学视角"),
    (": disease mechanisms and clinical management", "：疾病机制与临床管理"),
    (": mechanisms and emerging therapies", "：机制与新兴疗法"),
    (": mechanisms and therapeutic implications", "：机制与治疗启示"),
    (": from biology to clinic", "：从基础生物学到临床实践"),
    (": advances, challenges and future directions", "：进展、挑战与未来方向"),
    (": current concepts and future prospects", "：当前概念与未来展望"),
    ("pathophysiology of", "的病理生理学"),
    ("mechanisms of", "的生物学机制"),
    ("in cancer immunotherapy", "在肿瘤免疫治疗中的应用"),
    ("in cancer", "在癌症中的作用"),
    ("in health and disease", "在健康与疾病中的关键作用"),
    ("cellular senescence", "细胞衰老"),
    ("epigenetic regulation of", "的表观遗传调控"),
    ("tumor microenvironment", "肿瘤微环境"),
    ("mitochondrial dysfunction", "线粒体功能障碍"),
]


def default_terms(spark: SparkSession) -> DataFrame:
    names = ("term", "zh", "mode", "note", "aliases")
    return G.terms_frame(spark, [dict(zip(names, r, strict=True)) for r in DEFAULT_TERMS])


def rewritten_title(title: Column) -> Column:
    """A title with its known phrases put into Chinese, where no translation is at hand."""
    return T.rewrite(T.squash_ends(title), TITLE_RULES)
