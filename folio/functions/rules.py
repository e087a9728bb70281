"""Default rules of the research-paper field. All are parameters of the operators that use them."""

from __future__ import annotations

# Trigger words, signals, weights and wordings that results must agree on.

#: Query expansion: triggers, and the terms appended if one occurs.
EXPANSIONS = (
    (("数据集", "评价指标", "评估指标", "实验指标", "准确率"), "dataset benchmark evaluation metric accuracy top-1 top-5"),
    (("局限", "不足", "缺点", "问题", "未来工作"), "limitation limitations weakness drawback future work however"),
    (("贡献", "创新", "研究问题", "核心问题", "总结", "讲了什么"), "abstract introduction contribution contributions propose proposed method conclusion"),
    (("方法", "模型", "模块", "架构", "怎么做"), "method methodology architecture module framework model pipeline"),
    (("结果", "性能", "效果", "提升"), "results performance improvement outperform experiment"),
)

DATASET_TRIGGERS = ("数据集", "评价指标", "评估指标", "实验指标")
SUMMARY_TRIGGERS = ("贡献", "创新", "研究问题", "核心问题", "总结", "讲了什么")
LIMITATION_TRIGGERS = ("局限", "不足", "缺点", "未来工作")
METHOD_TRIGGERS = ("方法", "模型", "模块", "架构", "结构", "怎么做")

#: Intent bonus: triggers, parts. A part is (groups of signals, weight, cap); each group with a signal in the text counts once.
INTENTS = (
    (DATASET_TRIGGERS, (((("dataset",), ("ntu rgb",), ("kinetics",), ("top-1",), ("top-5",), ("accuracy",), ("metric",)), 0.035, 0.2),), 0.0),
    (SUMMARY_TRIGGERS, (((("abstract",),), 0.1, 0.1), ((("contribution",),), 0.16, 0.16), ((("we propose", "we develop", "we introduce"),), 0.14, 0.14)), 0.1),
    (LIMITATION_TRIGGERS, (((("limitation", "future work", "drawback"),), 0.2, 0.2),), 0.0),
    (METHOD_TRIGGERS, (((("architecture",), ("contains three components",), ("branch",), ("module",), ("block",), ("pipeline",), ("framework",)), 0.04, 0.24),), 0.0),
)  # the last number is the bonus of a first page

BIBLIOGRAPHY = ("arxiv preprint", "in proceedings", "transactions on")

NOISE_FALLBACK = "【检测到表格或公式内容，已隐藏乱码；请查看原文页。】"

#: Aspects of reading cards and comparisons.
ASPECTS = (
    ("研究问题", ("however", "challenge", "problem", "limitation", "existing methods", "fail to")),
    ("核心方法", ("we propose", "we present", "we introduce", "our method", "framework", "architecture")),
    ("数据集与指标", ("dataset", "ntu", "kinetics", "accuracy", "top-1", "f1", "metric", "benchmark")),
    ("主要发现", ("achieves", "outperform", "results", "improve", "state-of-the-art", "superior")),
    ("局限与未来工作", ("limitation", "limitations", "future work", "drawback", "remains challenging")),
)
OVERVIEW_ASPECT = "核心方法"
NOT_FOUND = "文档中未检索到明确表述。"

#: Best excerpt: words of research, signals of method.
RESEARCH_WORDS = ("propose", "contribution", "dataset", "metric", "limitation", "future work", "outperform")
EXCERPT_METHOD_SIGNALS = ("architecture", "component", "branch", "module", "block", "gate", "framework", "pipeline")

METRICS = (("Top-1 Accuracy", "top-1"), ("Top-5 Accuracy", "top-5"))
PLAIN_METRIC = ("accuracy", "分类准确率（Accuracy）")
SUMMARY_SLOTS = (
    ("problem", "研究问题", ("however", "challenge", "fail to", "limitation", "problem")),
    ("proposal", "核心方案", ("we propose", "we present", "we develop", "to address this gap", "to address these issues", "introduce")),
    ("result", "实验结论", ("achieves", "outperform", "results demonstrate", "experiments show")),
)
LIMITATION_WORDS = ("limitation", "limitations", "future work", "drawback")

TEXT_NO_EVIDENCE = "当前知识库中没有找到足够相关的证据。请换一种问法，或上传包含该信息的文档。"
TEXT_NO_LIMITATION = "当前检索范围内没有找到作者明确陈述的局限性或未来工作，因此不能可靠地替作者推断。建议确认是否上传了完整论文，或切换到包含 Discussion/Conclusion 的文档。"
TEXT_DATASETS, TEXT_METRICS, TEXT_RESULTS = "数据集", "评价指标", "论文报告的结果"
TEXT_NO_DATASETS, TEXT_NO_METRICS = "- 当前证据未明确列出数据集名称", "- 当前证据未明确列出评价指标"
TEXT_DATASET_END = "关键结论请结合下方页码引用核查。"
TEXT_METHOD_HEAD, TEXT_METHOD_END = "模型架构与关键模块", "以上结构均可在下方对应页码的原文证据中核查。"
TEXT_CONTRIBUTIONS, TEXT_SUMMARY_END = "关键贡献", "以上总结仅基于检索到的原文证据。"
TEXT_EXCERPTS_HEAD, TEXT_EXCERPTS_END = "证据摘要", "当前为本地证据抽取模式；关键结论请结合下方原文引用核查。"
PROMPT_HIT, PROMPT_QUESTION, PROMPT_EVIDENCE = "[证据 %d] 文件：%s，页码：%d\n%s", "用户问题：", "证据："
