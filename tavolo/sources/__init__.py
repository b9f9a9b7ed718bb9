from tavolo.sources.tables import TABLES, Tables

__all__ = ["TABLES", "Tables"]
