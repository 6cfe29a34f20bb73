"""Producers of facts: what a build runs, in which order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from factloom.plans.config import SelectionRules
from factloom.sources.syntax.facts import Facts
from factloom.sources.syntax.java_facts import java_facts
from factloom.sources.syntax.kotlin_facts import KotlinFile, kotlin_references, kotlin_sites, kotlin_symbols
from factloom.sources.syntax.xml_facts import xml_facts


class Source:
    """A file on its way through the producers, which share its tree."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text

    @cached_property
    def kotlin(self) -> KotlinFile:
        return KotlinFile(self.path, self.text)


@dataclass(frozen=True)
class Producer:
    """One kind of facts. suffix: the files it reads (empty: all); application: only where that one is asked for.

    read is called on the executors for each file and adds to its facts; without it, the build itself makes the rows. It
    sees changed files, or all (unchanged too) with every_file.
    """

    id: str
    namespace: str
    display_name: str
    suffix: str
    application: str | None = None
    read: Callable[[Source, Facts], None] | None = None
    every_file: bool = False

    def reads(self, path: str) -> bool:
        return path.endswith(self.suffix)

    def progress_total(self, changed_by_kind: dict[str, int]) -> int:
        return changed_by_kind.get(self.suffix[1:], 0) if self.suffix else sum(changed_by_kind.values())


class Registry:
    def __init__(self, producers: Sequence[Producer] = ()):
        self._held: dict[str, Producer] = {}
        for p in producers:
            self.register(p)

    def register(self, producer: Producer) -> None:
        """Builds run it from now on, instead of one that bore its id."""
        self._held[producer.id] = producer

    def get(self, name: str) -> Producer | None:
        return self._held.get(name)

    def all(self) -> list[Producer]:
        return list(self._held.values())

    def for_applications(self, names: Sequence[str], rules: SelectionRules | None = None) -> list[Producer]:
        """Those of no application always, then those of the applications in their order (unknown ones are ignored); hashes last, so that what breaks off is done again."""
        always = [p for p in self.all() if p.application is None and p.id != "file-hash"]
        asked = [p for name in dict.fromkeys(names) for p in self.all() if p.application == name]
        if rules is not None:
            asked = [replace(p, read=selection_reader(rules)) if p.id == "selection-context" else p for p in asked]
        return [*always, *asked, *(p for p in self.all() if p.id == "file-hash")]


def _java(source: Source, out: Facts) -> None:
    java_facts(source.path, source.text, out)


def _kotlin(source: Source, out: Facts) -> None:
    kotlin_symbols(source.kotlin, out)
    kotlin_references(source.kotlin, out)


def _xml(source: Source, out: Facts) -> None:
    xml_facts(source.path, source.text, out)


def selection_reader(rules: SelectionRules) -> Callable[[Source, Facts], None]:
    def read(source: Source, out: Facts) -> None:
        kotlin_sites(source.kotlin, out, rules.wrappers, rules.containers, rules.disablers, rules.annotation)

    return read


REGISTRY = Registry((
    Producer("java-source", "sym", "JavaSourceProducer", ".java", read=_java),
    Producer("kotlin-psi-symbols", "sym", "KotlinPsiSymbolProducer", ".kt", read=_kotlin),
    Producer("xml-resources", "res", "XmlResourceProducer", ".xml", read=_xml),
    Producer("selection-context", "compose", "SelectionContextProducer", ".kt", "selection-context", selection_reader(SelectionRules()), every_file=True),
    Producer("file-hash", "file", "FileHashProducer", ""),
))
