"""DataFrame operators over the ``files``, ``imports``, ``nodes``, ``edges`` and ``commits`` tables."""
