"""Readers: file trees with caps, scopes and ignored folders; text lines; JSON; registries."""
