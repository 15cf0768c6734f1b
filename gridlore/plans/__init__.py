"""Registered queries; importing this package's modules fills the registry."""
