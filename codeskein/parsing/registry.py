"""Which reader reads which file."""

from __future__ import annotations

from collections.abc import Callable

from codeskein.parsing import go_reader, python_reader, rust_reader, script_reader

# A reader takes (text, path) and returns one dict per declaration, in the order imports, classes
# each with their methods, functions, variables. Keys are the fields of `symbols.DECLARATIONS`.
Reader = Callable[[str, str], list[dict]]


class ParserRegistry:
    """Readers by language and languages by file suffix; five languages come built in."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}
        self._languages: dict[str, str] = {}
        self.register("python", [".py", ".pyw", ".pyi"], python_reader.read)
        self.register("typescript", [".ts", ".tsx", ".mts", ".cts"], script_reader.read)
        self.register("javascript", [".js", ".jsx", ".mjs", ".cjs"], script_reader.read_untyped)
        self.register("go", [".go"], go_reader.read)
        self.register("rust", [".rs"], rust_reader.read)

    def register(self, language: str, suffixes: list[str], reader: Reader) -> None:
        """Add a language or replace its reader. The reader travels to the executors by pickle."""
        self._readers[language] = reader
        self._languages.update({s: language for s in suffixes})

    def supported_extensions(self) -> list[str]:
        return list(self._languages)

    def supported_languages(self) -> list[str]:
        return list(self._readers)

    def get_parser(self, language: str) -> Reader | None:
        return self._readers.get(language)

    def language_of(self, path: str) -> str | None:
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        return self._languages.get(name[dot:].lower()) if dot > 0 else None

    def get_parser_for_file(self, path: str) -> Reader | None:
        return self._readers.get(self.language_of(path))
