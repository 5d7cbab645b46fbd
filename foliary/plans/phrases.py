"""Queries over phrases with known classes."""

from __future__ import annotations

from foliary.functions import classify as C
from foliary.functions.text import token_set
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

book.cases("legal_suffixes", "t string, r boolean", [
    ("Telecom S.A.", True), ("Acme Inc.", True), ("Norte S. de R.L. de C.V.", True), ("Sur, s a p i de c v", True), ("Casa", False), ("Smith & Co.", True), ("Smith & Co", False), ("Foo GmbH", True), ("Foo GmbH.", False),
    ("S.L. Norte", False), ("", False), (None, False),
], C.legal_suffix)
book.cases("organizations", "t string, r boolean", [("Universidad de Chile", True), ("Fundación Norte", True), ("Analista", False), ("Pepe Ltda", True), (" ", False), (None, False)], C.is_organization)
book.cases("job_titles", "t string, r boolean", [("Ingeniera de datos", True), ("Lead Developer", True), ("Analista Banco Sur", False), ("Chef 2", False), ("Técnico/QA", True), ("sistemas embebidos", False), (None, False)], C.is_job_title)
book.cases("title_case_names", "t string, r boolean", [("Telecom Argentina", True), ("Ministerio de Cultura", True), ("Bank of Ireland", True), ("Atención al cliente", False), ("Acme", False), ("Área 51", False), ("", False), (None, False)], C.is_title_case)
book.cases("language_levels", "t string, r boolean", [
    ("C1 - Advanced", True), ("B2+", True), ("nivel avanzado", True), ("Lectura técnica", True), ("Certificación avalada por una escuela muy buena", False), ("c3", False), ("Upper-Intermediate", True), ("---", False), (None, False),
], C.is_language_level)
book.cases("low_value_headings", "t string, r boolean", [
    ("4.2 Congresos", True), ("IV. Ponencias y comunicaciones", True), ("OTRAS PUBLICACIONES:", True), ("Experiencia", False), ("Referencias (2)", False), ("Research projects at home with old friends", False),
    ("• Hobbies", True), ("", False), (None, False),
], C.is_low_value_heading)
book.cases("shared_content", "a string, b string, r boolean", [("red blue green", "blue red", True), ("red red", "red", False), (None, "a", False)], lambda a, b: C.shares_content(token_set(a), token_set(b)))
