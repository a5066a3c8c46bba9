"""Readers of source trees and adapters of other tables to files."""
