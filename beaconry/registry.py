"""Names for things that configurations build."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Builders by name, with an optional parent that is asked next."""

    def __init__(self, name: str, parent: Registry | None = None) -> None:
        self.name, self.parent, self._builders = name, parent, {}

    def register(self, name: str | None = None, *, force: bool = False) -> Callable:
        def put(builder: Callable) -> Callable:
            key = name or builder.__name__
            if key in self._builders and not force:
                raise KeyError(f"{key} is registered in {self.name}")
            self._builders[key] = builder
            return builder

        return put

    def get(self, name: str) -> Callable | None:
        return self._builders.get(name) or (self.parent.get(name) if self.parent else None)

    def build(self, told: dict, **defaults) -> object:
        """What the builder named by ``told['type']`` makes of the other entries."""
        if "type" not in told:
            raise KeyError("'type' is missing")
        if (builder := self.get(told["type"])) is None:
            raise KeyError(f"{told['type']} isn't registered in {self.name}; known: {', '.join(self.names())}")
        return builder(**(defaults | {k: v for k, v in told.items() if k != "type"}))

    def names(self) -> list[str]:
        return sorted(self._builders)

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def __len__(self) -> int:
        return len(self._builders)


LOCALIZERS, METRICS, TRANSFORMS = Registry("localizers"), Registry("metrics"), Registry("transforms")
