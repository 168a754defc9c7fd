"""Registered queries and the fixture tables they run on."""


def all_queries():
    """Every registered query, in the order of its module."""
    import importlib
    import pkgutil

    import sparklore.plans as here
    from sparklore.plans.registry import REGISTRY

    for mod in sorted(m.name for m in pkgutil.iter_modules(here.__path__) if m.name.startswith("queries_")):
        importlib.import_module(f"sparklore.plans.{mod}")
    return dict(sorted(REGISTRY.items()))
