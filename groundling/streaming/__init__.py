"""The stateless rules and the claim gate on streams."""
