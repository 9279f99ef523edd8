"""Part of tokenloom."""
