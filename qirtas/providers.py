"""Shapes of chat clients. No client library is imported: a client is recognised by what it has."""

from __future__ import annotations

from abc import ABC, abstractmethod


def restored_text(text: str, vault: dict) -> str:
    """What ``restored`` does to a column, for one string on the driver."""
    for token, original in sorted(vault.items(), key=lambda e: -len(e[0])):
        text = text.replace(token, original)
    return text


class ProviderAdapter(ABC):
    """One shape of client. ``redact_request`` changes the request in place and gives (audits, vault, blocked)."""

    name = ""

    @abstractmethod
    def matches(self, client) -> bool:
        """Whether the client has this shape."""

    @abstractmethod
    def redact_request(self, guard, spark, request: dict, destination): ...

    @abstractmethod
    def invoke(self, client, request: dict): ...

    @abstractmethod
    def restore_response(self, response, vault: dict) -> None: ...


def _create(x):
    return getattr(x, "create", None)


class ChatCompletions(ProviderAdapter):
    """``client.chat.completions.create(messages=...)``."""

    def __init__(self) -> None:
        self.name = "openai"

    def matches(self, client) -> bool:
        return callable(_create(getattr(getattr(client, "chat", None), "completions", None)))

    def redact_request(self, guard, spark, request, destination):
        request["messages"], audits, vault, blocked = guard.protect_messages(spark, request.get("messages") or [], destination)
        return audits, vault, blocked

    def invoke(self, client, request):
        return client.chat.completions.create(**request)

    def restore_response(self, response, vault):
        for choice in getattr(response, "choices", None) or ():
            message = getattr(choice, "message", None)
            if getattr(message, "content", None):
                message.content = restored_text(message.content, vault)


class Messages(ProviderAdapter):
    """``client.messages.create(messages=..., system=...)``; the system prompt is protected like a message."""

    def __init__(self) -> None:
        self.name = "anthropic"

    def matches(self, client) -> bool:
        return getattr(client, "chat", None) is None and callable(_create(getattr(client, "messages", None)))

    def redact_request(self, guard, spark, request, destination):
        own = [{"content": request["system"]}] if request.get("system") else []
        safe, audits, vault, blocked = guard.protect_messages(spark, [*(request.get("messages") or []), *own], destination)
        if own:
            request["system"] = safe.pop()["content"]
        request["messages"] = safe
        return audits, vault, blocked

    def invoke(self, client, request):
        return client.messages.create(**request)

    def restore_response(self, response, vault):
        for block in getattr(response, "content", None) or ():
            own = block if isinstance(block, dict) else getattr(block, "__dict__", {})
            if isinstance(own.get("text"), str):
                own["text"] = restored_text(own["text"], vault)


_ADAPTERS: dict[str, ProviderAdapter] = {}


def register_adapter(one: ProviderAdapter) -> None:
    _ADAPTERS.update({one.name: one})


def get_adapter(provider: str) -> ProviderAdapter:
    if provider not in _ADAPTERS:
        raise ValueError(f"no adapter {provider!r}; there are {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[provider]


def resolve_adapter(client, provider: str = "auto") -> ProviderAdapter:
    if provider != "auto":
        return get_adapter(provider)
    fitting = [one for one in _ADAPTERS.values() if one.matches(client)]
    if not fitting:
        raise ValueError(f"no adapter knows this client; name one of {', '.join(sorted(_ADAPTERS))}")
    return fitting[0]


for _one in (ChatCompletions(), Messages()):
    register_adapter(_one)
