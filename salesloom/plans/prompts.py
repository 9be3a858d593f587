"""Prompt tables: instructions, KPI context and retrieved rows as bounded text.

The tables are the input of a user's own batch job; no model is called here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import cut, language_code
from ..operators.bundle import MetricsBundle, digest
from ..operators.documents import EmbedBatch
from ..operators.kpi import attach, null_safe_join
from ..operators.retrieval import DEFAULT_TOP_K, context_block, retrieved_rows, search
from . import context
from .report import report_text_column

# Prompt texts.
SYSTEM_REPORT = {
    "en": (
        "You are a financial analyst assistant helping to explain business performance.\n"
        "All monetary values are in Indonesian Rupiah (IDR) and must be shown using the 'Rp' "
        "format.\n"
        "Use only the metrics and summaries provided in the context. Do not invent new "
        "transactions, dates, or customer details.\n"
        "Write your response in clear, structured English suitable for a non-technical "
        "business manager."
    ),
    "id": (
        "Anda adalah asisten analis keuangan yang membantu menjelaskan kinerja bisnis.\n"
        "Semua nilai uang menggunakan Rupiah Indonesia (IDR) dan harus ditulis dengan format "
        "'Rp'.\n"
        "Gunakan hanya metrik dan ringkasan yang diberikan dalam konteks. Jangan mengarang "
        "transaksi baru, tanggal yang tidak ada, atau detail pelanggan.\n"
        "Tuliskan jawaban dalam Bahasa Indonesia yang jelas, terstruktur, dan mudah dipahami "
        "oleh manajer bisnis non-teknis."
    ),
}
SYSTEM_CHAT = {
    "en": (
        "You are a financial analyst assistant answering questions about sales data.\n"
        "Use only the metrics provided in the context. If some information is not available, "
        "explain the limitation honestly instead of guessing.\n"
        "Answer in concise, clear English."
    ),
    "id": (
        "Anda adalah asisten analis keuangan yang menjawab pertanyaan tentang data "
        "penjualan.\n"
        "Gunakan hanya metrik yang diberikan dalam konteks. Jika informasi tidak tersedia, "
        "jelaskan keterbatasannya dengan jujur.\n"
        "Jawaban harus dalam Bahasa Indonesia yang singkat, jelas, dan membantu."
    ),
}
REPORT_INSTRUCTIONS = {
    "en": (
        "Use the following metrics summary to write a narrative report about business "
        "performance.\n"
        "Focus on: overall overview, the most important segments, trends over time, and any "
        "recent anomalies.\n"
        "Explain the key numbers, provide brief interpretation, and highlight insights that "
        "could help management make decisions.\n"
        "Make sure the entire report is written in English."
    ),
    "id": (
        "Gunakan ringkasan metrik berikut untuk menulis laporan naratif tentang kinerja "
        "keuangan.\n"
        "Fokus pada: gambaran umum, segmen yang paling berkontribusi, tren dari waktu ke "
        "waktu, dan adanya anomali terbaru.\n"
        "Jelaskan angka-angka utama, berikan interpretasi singkat, dan berikan insight yang "
        "bisa dipakai manajemen untuk mengambil keputusan.\n"
        "Pastikan seluruh laporan ditulis dalam Bahasa Indonesia."
    ),
}
QUESTION_INSTRUCTIONS = {
    "en": (
        "Answer the user's question based on the following metrics summary.\n"
        "Use only the information present in this summary. If the requested detail is not "
        "available, explain that limitation honestly instead of guessing.\n"
        "If helpful, you may refer to what a CLI-style command (such as 'trend' or 'top "
        "categories') would show, but do not invent new numbers."
    ),
    "id": (
        "Jawablah pertanyaan pengguna berdasarkan ringkasan metrik berikut.\n"
        "Gunakan hanya informasi yang ada di ringkasan ini. Jika data yang diminta tidak "
        "tersedia, jelaskan keterbatasannya secara jujur.\n"
        "Jika relevan, Anda boleh menyebutkan jenis informasi yang kira-kira akan ditampilkan "
        "oleh perintah CLI tertentu (misalnya 'trend', 'top categories'), namun jangan "
        "mengarang angka baru."
    ),
}
QUESTION_LABEL = {"en": "User question", "id": "Pertanyaan pengguna"}
SUMMARY_HEADING = "Structured metrics summary:"
TEMPLATE_HEADING = ("Existing template-based report (you may refine and expand this, but stay "
                    "faithful to the numbers):")
COMMANDS_HEADING = {
    "en": ("Available CLI-style commands (for reference; you do not need to repeat the exact "
           "syntax):"),
    "id": ("Perintah CLI yang tersedia (untuk referensi, Anda tidak perlu mengulang sintaks "
           "persisnya):"),
}
COMMANDS = {
    "en": {
        "summary": "short summary of overall performance",
        "overview": "overview of key metrics",
        "top categories": "categories contributing most revenue",
        "top products": "products contributing most revenue",
        "top customers": "customers contributing most revenue",
        "top channels": "sales channels contributing most revenue",
        "trend": "trend in revenue over time",
        "anomaly": "recent daily revenue anomaly check",
        "time series": "aggregated revenue time series",
    },
    "id": {
        "summary": "ringkasan singkat performa keseluruhan",
        "overview": "gambaran umum metrik utama",
        "top categories": "kategori dengan kontribusi pendapatan terbesar",
        "top products": "produk dengan kontribusi pendapatan terbesar",
        "top customers": "pelanggan dengan kontribusi pendapatan terbesar",
        "top channels": "saluran penjualan dengan kontribusi pendapatan terbesar",
        "trend": "tren pendapatan dari waktu ke waktu",
        "anomaly": "pemeriksaan anomali pendapatan harian terakhir",
        "time series": "deret waktu pendapatan agregat",
    },
}
WHITE_SPACE = " \t\n\r\f\x0b"


def commands_text(language: str = "en", commands: Sequence[str] | None = None) -> str:
    """Heading and one line per command; a command without a description stands alone."""
    lang = language_code(language)
    known = COMMANDS[lang]
    chosen = list(known) if commands is None else list(commands)
    if not chosen:
        return ""
    lines = [f"- {c}: {known[c]}" if c in known else f"- {c}" for c in chosen]
    return "\n".join([COMMANDS_HEADING[lang], *lines])


def with_block(prompt: Column, block: Column | None, max_chars: int | None) -> Column:
    """Prompt, then the block of retrieved rows if there is one, within ``max_chars``."""
    if block is not None:
        has_block = F.length(block) > 0
        prompt = F.when(has_block, F.concat(prompt, F.lit("\n\n"), block)).otherwise(prompt)
    return prompt if max_chars is None else cut(prompt, max_chars, context.TRUNCATED)


def report_prompt(row: DataFrame, segment_types: Sequence[str], language: str = "en",
                  hybrid: bool = False) -> Column:
    lang = language_code(language)
    lines = [F.lit(REPORT_INSTRUCTIONS[lang]), F.lit(""), F.lit(SUMMARY_HEADING),
             context.context_text(row, segment_types)]
    if hybrid:
        report = F.btrim(report_text_column(row, segment_types, language), F.lit(WHITE_SPACE))
        lines += [F.lit(""), F.lit(TEMPLATE_HEADING), report]
    return F.concat_ws("\n", *lines)


def report_search(bundle: MetricsBundle, index: DataFrame, top_k_rows: int | None = 5,
                  provider: EmbedBatch | None = None) -> DataFrame:
    """Transactions that explain the KPIs: ``by, query, filters, rank, …`` per group."""
    row = digest(bundle)
    asked = row.select(*bundle.by, context.report_query().alias("query"),
                       context.report_filters().alias("filters"))
    if bundle.by:
        keyed = asked.select(*bundle.by, "query")
        found = retrieved_rows(search(keyed, index, "query", bundle.by, top_k_rows, provider))
        return null_safe_join(found, asked, bundle.by, "inner")
    one = asked.select("query", F.lit(0).alias("report"))
    found = retrieved_rows(search(one, index, "query", ["report"], top_k_rows, provider))
    return attach(found, asked, (), "asked").select("asked.*", *found.columns).drop("report")


def report_prompts(bundle: MetricsBundle, language: str = "en", hybrid: bool = False,
                   index: DataFrame | None = None, max_chars: int | None = None,
                   provider: EmbedBatch | None = None,
                   top_k_rows: int = DEFAULT_TOP_K) -> DataFrame:
    """One prompt pair per group: ``by, system_prompt, user_prompt``.

    With an ``index`` the ``top_k_rows`` most similar transactions follow as a block;
    ``max_chars`` bounds the whole user prompt.
    """
    row = digest(bundle)
    keys = list(bundle.by) or ["report"]
    prompts = row if bundle.by else row.withColumn("report", F.lit(0))
    block = None
    if index is not None:
        asked = prompts.select(*keys, context.report_query().alias("query"))
        rows = retrieved_rows(search(asked, index, "query", keys, top_k_rows, provider))
        blocks = context_block(rows, keys, language, "report", top_k_rows,
                               marker=max_chars is not None)
        if not bundle.by:
            blocks = blocks.drop("report")
        prompts = attach(prompts, blocks, bundle.by, "found")
        block = F.col("found.block")
    user = with_block(report_prompt(row, bundle.segment_types, language, hybrid), block,
                      max_chars)
    return prompts.select(*bundle.by,
                          F.lit(SYSTEM_REPORT[language_code(language)]).alias("system_prompt"),
                          user.alias("user_prompt"))


def question_prompts(questions: DataFrame, bundle: MetricsBundle, keys: Sequence[str],
                     question_col: str = "question", language: str = "en",
                     commands: Sequence[str] | None = None, blocks: DataFrame | None = None,
                     max_chars: int | None = None) -> DataFrame:
    """One prompt pair per question: ``keys, system_prompt, user_prompt``.

    The KPI context is computed once and reaches the questions as a scalar (or, for a
    bundle with ``by``, by a join on those columns of the questions). ``blocks`` are the
    retrieved rows per question (``keys, block``).
    """
    lang = language_code(language)
    row = digest(bundle)
    summary = row.select(*bundle.by, context.context_text(row, bundle.segment_types)
                         .alias("summary"))
    asked = attach(questions, summary, bundle.by, "kpi")
    block = None
    if blocks is not None:
        asked, block = null_safe_join(asked, blocks, keys), F.col("block")
    listed = commands_text(language, commands)
    lines = [F.lit(QUESTION_INSTRUCTIONS[lang])]
    if listed:
        lines += [F.lit(""), F.lit(listed)]
    lines += [F.lit(""), F.lit(SUMMARY_HEADING), F.col("kpi.summary"), F.lit(""),
              F.lit(f"{QUESTION_LABEL[lang]}:"),
              F.btrim(F.col(question_col), F.lit(WHITE_SPACE))]
    user = with_block(F.concat_ws("\n", *lines), block, max_chars)
    return asked.select(*keys, F.lit(SYSTEM_CHAT[lang]).alias("system_prompt"),
                        user.alias("user_prompt"))
