"""Readers and writers of recorded surfaces, frame logs, manifests and published documents."""
