"""What a corpus is, by its name and path: display name, key of the same corpus from another place, format, unit; and which sources to read."""

from __future__ import annotations

import re
import unicodedata

from . import formats

# What a corpus's name or path holds, and its display name. A star stands for any signs between; case does not count. The
# first rule that fits counts.
DISPLAY_NAMES = (
    (("NIKL_DIALOGUE_2020", "DIALOGUE_2020"), "일상 대화 말뭉치 2020"),
    (("NIKL_DIALOGUE_2023", "DIALOGUE_2023"), "일상 대화 말뭉치 2023"),
    (("NIKL_DIALOGUE_2024", "DIALOGUE_2024"), "일상 대화 말뭉치 2024"),
    (("NIKL_MESSENGER", "MESSENGER"), "메신저 말뭉치"),
    (("NIKL_CI_2023", "CI_2023"), "맥락 추론 말뭉치 2023"),
    (("NIKL_CI_2024", "CI_2024"), "맥락 추론 말뭉치 2024"),
    (("NIKL_IU_2023", "IU_2023"), "비윤리 문장 탐지 말뭉치 2023"),
    (("NIKL_NEWSPAPER", "NIKLNEWSPAPER", "NEWSPAPER"), "신문 말뭉치"),
    (("NIKL_WRITTEN", "WRITTEN"), "문어 말뭉치"),
    (("NIKL_SPOKEN", "SPOKEN"), "구어 말뭉치"),
    (("NIKL_Korean_Dialect", "Dialect"), "지역어 구술 발화 말뭉치"),
    (("NIKL_OM", "온라인 대화"), "온라인 대화 말뭉치"),
    (("NIKL_OPM", "게시자료"), "온라인 게시자료 말뭉치"),
    (("NIKL_CoLA", "CoLA"), "문법성 판단 말뭉치"),
    (("NIKL_PARAPHRASE", "NIKL_PC", "PARAPHRASE"), "유사 문장 말뭉치"),
    (("NIKL_CF", "의미역 기술"), "의미역 기술 모형"),
    (("NIKL_DP", "NIKL_MP", "NIKL_SR", "NIKL_ZA", "NIKL_SC"), "분석 말뭉치"),
    (("Historical Korean Corpus 2024",), "역사 말뭉치 2024"),
    (("NIKL_Historical Korean Corpus 2023", "Historical Korean Corpus 2023"), "역사 말뭉치 2023"),
    (("21세기 세종계획", "21세기세종계획", "sejong"), "21세기 세종계획 말뭉치"),
)
# The same for the key by which two copies of a corpus are known as one.
KEYS = (
    (("NIKL_DIALOGUE_2020", "DIALOGUE_2020"), "nikl-dialogue-2020"),
    (("NIKL_DIALOGUE_2023", "DIALOGUE_2023"), "nikl-dialogue-2023"),
    (("NIKL_DIALOGUE_2024", "DIALOGUE_2024"), "nikl-dialogue-2024"),
    (("NIKL_MESSENGER*JSON", "MESSENGER*JSON"), "nikl-messenger-json"),
    (("NIKL_MESSENGER*CSV", "MESSENGER*CSV"), "nikl-messenger-csv"),
    (("NIKL_CI_2023", "CI_2023"), "nikl-ci-2023"),
    (("NIKL_CI_2024", "CI_2024"), "nikl-ci-2024"),
    (("NIKL_IU_2023", "IU_2023"), "nikl-iu-2023"),
    (("NIKLNEWSPAPER_2022", "NIKL_NEWSPAPER_2022"), "nikl-newspaper-2022"),
    (("NIKL_NEWSPAPER_2020",), "nikl-newspaper-2020"),
    (("NIKL_NEWSPAPER_2021",), "nikl-newspaper-2021"),
    (("NIKL_NEWSPAPER_2023",), "nikl-newspaper-2023"),
    (("NIKL_NEWSPAPER_2024",), "nikl-newspaper-2024"),
    (("NIKL_NEWSPAPER_CSV", "NIKL_NEWSPAPER_v2.0", "NEWSPAPER_CSV", "NEWSPAPER_v2.0"), "nikl-newspaper-v2"),
    (("NIKL_WRITTEN",), "nikl-written-v1"),
    (("NIKL_SPOKEN",), "nikl-spoken-v1"),
    (("NIKL_Korean_Dialect", "Dialect"), "nikl-dialect-2021"),
    (("NIKL_OM",), "nikl-om-2021"),
    (("NIKL_OPM",), "nikl-opm-2022"),
    (("NIKL_CoLA", "CoLA"), "nikl-cola-v1"),
    (("NIKL_PARAPHRASE", "NIKL_PC", "PARAPHRASE"), "nikl-paraphrase-pc"),
    (("NIKL_CF",), "nikl-cf-v1"),
    (("NIKL_DP_2024",), "nikl-dp-2024"),
    (("NIKL_DP",), "nikl-dp-v2"),
    (("NIKL_MP",), "nikl-mp-v1"),
    (("NIKL_SR",), "nikl-sr-v1"),
    (("NIKL_ZA_2024",), "nikl-za-2024"),
    (("NIKL_ZA",), "nikl-za-2020"),
    (("NIKL_SC",), "nikl-sc-v1"),
    (("Historical Korean Corpus 2024",), "nikl-historical-2024"),
    (("NIKL_Historical Korean Corpus 2023", "Historical Korean Corpus 2023"), "nikl-historical-2023"),
    (("21세기 세종계획", "21세기세종계획", "sejong"), "sejong-21c"),
)
# The same for the format.
FORMATS = (
    (("NIKL_DIALOGUE", "DIALOGUE_"), formats.DIALOGUE),
    (("NIKL_MESSENGER", "MESSENGER"), formats.DIALOGUE),
    (("NIKL_SPOKEN", "SPOKEN", "NIKL_Korean_Dialect", "Dialect", "NIKL_OM"), formats.DIALOGUE),
    (("NIKL_CI_2024", "CI_2024"), formats.CI),
    (("NIKL_CI_2023", "CI_2023"), formats.NESTED),
    (("NIKL_IU_2023", "IU_2023"), formats.WEB),
    (("NIKL_NEWSPAPER", "NIKLNEWSPAPER", "NIKL_WRITTEN", "NIKL_OPM"), formats.PARAGRAPHS),
    (("NIKL_DP", "NIKL_MP", "NIKL_SR", "NIKL_ZA", "NIKL_SC"), formats.SENTENCES),
    (("NIKL_PARAPHRASE", "NIKL_PC", "PARAPHRASE"), formats.PARAPHRASES),
    (("NIKL_CoLA", "CoLA"), formats.COLA),
    (("NIKL_CF", "의미역 기술"), formats.FRAMES),
    (("Historical Korean Corpus", "역사 말뭉치"), formats.HISTORICAL),
    (("21세기 세종계획", "21세기세종계획", "sejong"), formats.TEI),
)
KNOWN = {
    formats.DIALOGUE, formats.NESTED, formats.CI, formats.WEB, formats.PARAGRAPHS, formats.SENTENCES, formats.PARAPHRASES, formats.TABLE, formats.COLA, formats.FRAMES, formats.HISTORICAL, formats.TEI,
}
UNKNOWN_FORMAT, UTTERANCE_LABEL, SENTENCE_LABEL = "unknown", "발화", "문장"


def _holds(text: str, part: str) -> bool:
    """Whether the pieces of ``part`` between stars follow each other in a line of the text."""
    for line in text.split("\n"):
        at = 0
        for piece in part.split("*"):
            at = line.find(piece, at)
            if at < 0:
                break
            at += len(piece)
        else:
            return True
    return False


def _first(rules: tuple[tuple[tuple[str, ...], str], ...], text: str) -> str | None:
    text = re.sub(r"[^\S\n]+", " ", text).lower()
    return next((value for parts, value in rules if any(_holds(text, p.lower()) for p in parts)), None)


def _described(name: str, path: str) -> str:
    return unicodedata.normalize("NFKC", f"{name} {path}")


def display_name(name: str, path: str = "") -> str:
    return _first(DISPLAY_NAMES, _described(name, path)) or name or path.strip()


def corpus_key(name: str, path: str = "") -> str:
    text = _described(name, path).replace("\\", "/")
    return _first(KEYS, text) or re.sub(r"\.[^.]*$", "", text.rsplit("/", 1)[-1]).strip().lower()


def format_of(name: str, path: str = "") -> str:
    return _first(FORMATS, _described(name, path)) or UNKNOWN_FORMAT


def format_in(metadata: dict) -> str:
    """The format that a document's metadata names."""
    found = metadata.get("sourceFormat")
    return found if isinstance(found, str) and found in KNOWN else UNKNOWN_FORMAT


def is_dialogue(source_format: str) -> bool:
    return source_format in (formats.DIALOGUE, formats.NESTED)


def unit_label(source_format: str) -> str:
    return UTTERANCE_LABEL if is_dialogue(source_format) else SENTENCE_LABEL


def is_pseudo_speaker(speaker: dict | str | None) -> bool:
    """Whether a speaker, or a speaker's id, stands for a text without speakers."""
    if isinstance(speaker, str):
        return speaker.strip().lower() == formats.PSEUDO_SPEAKER
    speaker = speaker or {}
    named = speaker.get("id") if speaker.get("id") is not None else speaker.get("speaker_id")
    return str(named if named is not None else "").strip().lower() == formats.PSEUDO_SPEAKER or speaker.get("pseudo") is True


def _messenger(path: str, kind: str) -> bool:
    return bool(re.search(f"MESSENGER.*{kind}", path, re.I))


def _newspaper(path: str) -> tuple[bool, bool, str]:
    """Whether a source is of newspapers, whether as CSV, and its year."""
    name = unicodedata.normalize("NFKC", path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1])
    year = re.search(r"20\d\d", name)
    return bool(re.search("NIKL_?NEWSPAPER", name, re.I)), bool(re.search("CSV", name, re.I)), year[0] if year else "all"


def is_messenger_csv(path: str) -> bool:
    return _messenger(path, "CSV")


def without_repeated(paths: list[str]) -> list[str]:
    """Sources without those that others hold better: messenger CSV beside JSON, and newspaper CSV beside other files of its year."""
    better = {year for paper, csv, year in map(_newspaper, paths) if paper and not csv}
    json = any(_messenger(p, "JSON") for p in paths)

    def stays(path: str) -> bool:
        paper, csv, year = _newspaper(path)
        return not (json and is_messenger_csv(path)) and not (paper and csv and year in better)

    return [p for p in paths if stays(p)]
